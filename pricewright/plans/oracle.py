"""DuckDB SQL restatements of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the same tables."""

from __future__ import annotations

# Written out here, not taken from the engine: a wrong pattern there must not pass on both sides.
FLOAT_LITERAL = "^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")   # as Python's str.strip has it

ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

LISTINGS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  concat(' ', p_name, '  ', lower(p_type), ' ') AS part_name,
  CASE WHEN l_discount = 0.01 THEN 'unknown' ELSE concat(p_type, ' ', split_part(p_name, ' ', 2)) END AS part_type,
  CASE WHEN l_tax = 0.08 THEN 'Unknown' ELSE p_brand END AS part_brand,
  split_part(p_name, ' ', 2) AS scraped_category,
  CASE WHEN l_returnflag = 'R' THEN 'Universal' WHEN l_discount = 0 THEN '' ELSE concat('Make ', n_nationkey % 5) END AS compatible_make,
  CASE WHEN l_returnflag = 'R' THEN 'Universal' ELSE concat('Model ', l_suppkey % 2) END AS compatible_model,
  CASE WHEN l_linestatus = 'O' THEN CAST(year(o_orderdate) AS STRING) END AS year_from,
  CASE WHEN l_quantity = 50 THEN '2099' ELSE CAST(year(l_shipdate) AS STRING) END AS year_to,
  CASE WHEN l_tax = 0 THEN '0' ELSE CAST(l_extendedprice AS STRING) END AS price_pkr,
  CASE WHEN l_discount >= 0.05 THEN round(l_extendedprice / (1 - l_discount), 2) ELSE 0.0 END AS price_original_pkr,
  CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN 'New' ELSE 'Used' END AS condition,
  l_linestatus = 'O' AS available,
  concat('Site', l_suppkey % 3) AS website,
  CASE WHEN l_quantity = 1 THEN '' ELSE concat('https://shop.example/shop/', l_partkey, '-', l_suppkey % 4) END AS product_url,
  CASE WHEN l_discount = 0.02 THEN concat('About ', p_name) ELSE '' END AS description,
  l_linenumber AS _lin, l_discount AS _disc
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
"""


SP = " " * len(WS_CHARS)


def cs(x):
    """clean string"""
    return f"trim(regexp_replace(translate(coalesce({x}, ''), '{WS_CHARS}', '{SP}'), ' +', ' ', 'g'))"


def wtrim(x):
    return f"trim({x}, ' {WS_CHARS}')"


def cprice(x):
    s = wtrim(f"replace(coalesce(CAST({x} AS VARCHAR), '0'), ',', '')")
    return (f"CASE WHEN regexp_matches({s}, '{FLOAT_LITERAL}') AND isfinite(TRY_CAST({s} AS DOUBLE)) "
            f"THEN round(TRY_CAST({s} AS DOUBLE), 2) ELSE 0.0 END")


def cyear(x):
    y = f"CASE WHEN regexp_matches({x}, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(trim({x}) AS INTEGER) END"
    return f"CASE WHEN ({y}) BETWEEN 1980 AND 2030 THEN ({y}) END"


def key_sql():
    u = "lower(" + wtrim("coalesce(product_url, '')") + ")"
    n = "lower(" + wtrim("coalesce(part_name, '')") + ")"
    return f"CASE WHEN {u} <> '' THEN {u} ELSE {n} END"


def truthy_sql():
    s = [f"(CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN 1 ELSE 0 END)"
         for c in ["part_name", "part_type", "part_brand", "scraped_category", "compatible_make",
                   "compatible_model", "condition", "website", "product_url", "description"]]
    n = [f"(CASE WHEN {c} IS NOT NULL AND {c} <> 0 THEN 1 ELSE 0 END)"
         for c in ["year_from", "year_to", "price_pkr", "price_original_pkr"]]
    b = ["(CASE WHEN available THEN 1 ELSE 0 END)"]
    return " + ".join(s + n + b)


CLEAN_COLS = ("part_name, part_type, part_brand, scraped_category, compatible_make, compatible_model, "
              "year_from, year_to, price_pkr, price_original_pkr, condition, available, website, "
              "product_url, description")

CLEANED = f"""
SELECT {ORD},
  {cs('part_name')} AS part_name, {cs('part_type')} AS part_type, {cs('part_brand')} AS part_brand,
  {cs('scraped_category')} AS scraped_category, {cs('compatible_make')} AS compatible_make,
  {cs('compatible_model')} AS compatible_model,
  {cyear('year_from')} AS year_from, {cyear('year_to')} AS year_to,
  {cprice('price_pkr')} AS price_pkr, {cprice('price_original_pkr')} AS price_original_pkr,
  CASE WHEN {cs("coalesce(condition, 'New')")} = '' THEN 'New' ELSE {cs("coalesce(condition, 'New')")} END AS condition,
  coalesce(available, true) AS available, coalesce(website, '') AS website,
  coalesce(product_url, '') AS product_url, substr({cs('description')}, 1, 500) AS description
FROM listings WHERE part_name IS NOT NULL AND part_name <> ''
"""

LIVE = "SELECT * FROM cleaned WHERE (price_pkr > 0 AND NOT isnan(price_pkr)) OR available"


def first_pos(part):
    return ", ".join(f"first_value({c}) OVER (PARTITION BY k ORDER BY {ORD}) AS {c}"
                     for c in ORD.split(", "))


# the position must come from all rows of the key, so compute it before QUALIFY
UNIQUE = f"""
SELECT p1 AS l_orderkey, p2 AS l_linenumber, p3 AS l_partkey, p4 AS l_suppkey, p5 AS l_extendedprice,
       {CLEAN_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, {ORD}) AS rn_w,
    first_value(l_orderkey) OVER w AS p1, first_value(l_linenumber) OVER w AS p2,
    first_value(l_partkey) OVER w AS p3, first_value(l_suppkey) OVER w AS p4,
    first_value(l_extendedprice) OVER w AS p5
  FROM (SELECT *, {key_sql()} AS k, {truthy_sql()} AS score FROM live) t
  WHERE k <> ''
  WINDOW w AS (PARTITION BY k ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE rn_w = 1
"""


def with_(*ctes, body):
    """Compose named CTEs (listings, cleaned, live, unique, ...) and a body."""
    known = {"listings": LISTINGS, "cleaned": CLEANED, "live": LIVE, "uniq": UNIQUE,
             **EXTRA_CTES}
    parts = [f"{name} AS ({known[name]})" for name in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _g(c):
    return f"lower({wtrim(f'coalesce({c}, {chr(39)}{chr(39)})')})"


ALTS = f"""
SELECT u.*, {_g('part_type')} AS gt, {_g('compatible_make')} AS gm, {_g('compatible_model')} AS gmo
FROM uniq u
"""

ALT_PAIRS = f"""
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice,
  row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice
                     ORDER BY b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_extendedprice) AS pos,
  b.part_name, b.part_brand, b.price_pkr, b.product_url
FROM keyed a JOIN keyed b ON a.gt = b.gt AND a.gm = b.gm AND a.gmo = b.gmo AND a.product_url <> b.product_url
WHERE a.gt <> '' AND a.gm <> '' AND a.gm <> 'universal'
"""

EXTRA_CTES = {
    "keyed": ALTS,
    "pairs": ALT_PAIRS,
    "final": """SELECT u.*, CAST(coalesce(c.n, 0) AS INTEGER) AS alternatives_count FROM uniq u LEFT JOIN
        (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) AS n
         FROM pairs WHERE pos <= 10 GROUP BY ALL) c USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""",
}

PIPE = ("listings", "cleaned", "live", "uniq")


def lower_not_in(c, toks):
    lst = ", ".join(f"'{t}'" for t in toks)
    return f"({c} IS NOT NULL AND {c} <> '' AND lower({c}) NOT IN ({lst}))"


def _blank_token(c, trim=True):
    v = f"lower(coalesce({c}, ''))"
    if trim:
        v = wtrim(v)
    return f"({v} = '' OR {v} IN ('unknown', 'n/a', 'none'))"


PRICED_DEDUP = f"""
SELECT p1 AS l_orderkey, p2 AS l_linenumber, p3 AS l_partkey, p4 AS l_suppkey, p5 AS l_extendedprice,
  {CLEAN_COLS} FROM (
  SELECT *,
    row_number() OVER (PARTITION BY k ORDER BY {ORD}) AS rn_first,
    row_number() OVER (PARTITION BY k ORDER BY CASE WHEN price_pkr > 0 AND NOT isnan(price_pkr) THEN 0 ELSE 1 END, {ORD}) AS rn_priced,
    first_value(price_pkr) OVER w AS first_price,
    max(CASE WHEN price_pkr > 0 AND NOT isnan(price_pkr) THEN 1 ELSE 0 END) OVER w AS any_priced,
    first_value(l_orderkey) OVER w AS p1, first_value(l_linenumber) OVER w AS p2,
    first_value(l_partkey) OVER w AS p3, first_value(l_suppkey) OVER w AS p4,
    first_value(l_extendedprice) OVER w AS p5
  FROM (SELECT *, {key_sql()} AS k FROM cleaned) t WHERE k <> ''
  WINDOW w AS (PARTITION BY k ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE CASE WHEN first_price = 0 AND any_priced = 1 THEN rn_priced = 1 ELSE rn_first = 1 END
"""
EXTRA_CTES["priced"] = PRICED_DEDUP


def _round4(q: dict) -> dict:
    from pricewright.plans.registry import ROUND4
    for name, cols in ROUND4.items():
        if name in q:
            rep = ", ".join(f"round({c}, 4) AS {c}" for c in cols)
            q[name] = f"SELECT * REPLACE ({rep}) FROM ({q[name]})"
    return q


def oracle() -> dict:
    q = {**oracle_more(), **oracle_features(), **oracle_eval(), **oracle_text(), **oracle_enrich(),
         **oracle_score(), **oracle_pages()}
    q["clean_strings"] = with_("listings", body=f"""
        SELECT {ORD}, {cs('part_name')} AS part_name, {cs('part_type')} AS part_type,
               {cs('description')} AS description, {wtrim('part_name')} AS name_stripped FROM listings""")
    q["clean_prices"] = with_("listings", body=f"""
        SELECT {ORD}, {cprice('price_pkr')} AS price_pkr, {cprice('price_original_pkr')} AS price_original_pkr,
               {cprice("format('{:,.2f}', l_extendedprice)")} AS price_commas FROM listings""")
    q["clean_years"] = with_("listings", body=f"""
        SELECT {ORD}, {cyear('year_from')} AS year_from, {cyear('year_to')} AS year_to,
               {cyear("concat(year_to, '.0')")} AS year_decimal FROM listings""")
    q["clean_listings"] = with_("listings", "cleaned", body="SELECT * FROM cleaned")
    q["drop_dead"] = with_("listings", "cleaned", "live", body="SELECT * FROM live")
    q["zero_price_items"] = with_("listings", "cleaned",
                                  body="SELECT * FROM cleaned WHERE price_pkr IS NULL OR price_pkr <= 0")
    q["needs_enrichment"] = with_("listings", "cleaned", body=f"""
        SELECT {ORD}, ({_blank_token('compatible_make')} OR {_blank_token('part_type')}) AS needs_enrichment,
               {_blank_token('compatible_make', False)} AS needs_make FROM cleaned""")
    q["price_note"] = with_("listings", "cleaned", "live", body=f"""
        SELECT {ORD}, price_pkr, available,
          CASE WHEN (price_pkr IS NULL OR price_pkr <= 0) AND available
               THEN 'Variable pricing - contact seller' END AS price_note FROM live""")
    q["dedupe_richest"] = with_(*PIPE, body="SELECT * FROM uniq")
    q["dedupe_priced"] = with_("listings", "cleaned", "priced", body="SELECT * FROM priced")
    q["alternatives"] = with_(*PIPE, "keyed", "pairs", body="SELECT * FROM pairs WHERE pos <= 10")
    q["final_flatten"] = with_(*PIPE, "keyed", "pairs", "final", body="SELECT * FROM final")
    q["union_sources"] = with_("listings", "cleaned", body=f"""
        SELECT {ORD}, 'listing' AS source, part_name, price_pkr, NULL::VARCHAR AS price_note FROM cleaned
        UNION ALL
        SELECT {ORD}, 'repair' AS source, part_name, price_pkr,
          CASE WHEN available THEN 'Variable pricing - contact seller' END AS price_note
        FROM cleaned WHERE price_pkr IS NULL OR price_pkr <= 0""")
    q["dataset_stats"] = with_(*PIPE, "keyed", "pairs", "final", body=f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE available) AS available,
          count(*) FILTER (WHERE NOT coalesce(available, false)) AS unavailable,
          count(*) FILTER (WHERE price_pkr > 0 AND NOT isnan(price_pkr)) AS with_price,
          count(*) FILTER (WHERE {lower_not_in('compatible_make', ['unknown', 'n/a', 'none'])}) AS with_make,
          count(*) FILTER (WHERE {lower_not_in('compatible_model', ['unknown', 'n/a', 'none', 'universal'])}) AS with_model,
          count(*) FILTER (WHERE lower(coalesce(compatible_make, '')) = 'universal') AS universal,
          count(*) FILTER (WHERE {lower_not_in('part_brand', ['unknown', 'n/a', 'none'])}) AS with_brand,
          count(*) FILTER (WHERE alternatives_count > 0) AS with_alternatives
        FROM final""")
    q["scrape_summary"] = with_("listings", "cleaned", "priced", body=f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(available, true)) AS available,
          count(*) FILTER (WHERE NOT coalesce(available, true)) AS unavailable,
          count(*) FILTER (WHERE {lower_not_in('compatible_make', ['unknown', 'n/a'])}) AS enriched
        FROM priced""")
    q["top_categories"] = with_(*PIPE, body="""
        SELECT scraped_category AS value, count(*) AS n FROM uniq GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
    q["top_makes"] = with_(*PIPE, body="""
        SELECT compatible_make AS value, count(*) AS n FROM uniq
        WHERE compatible_make IS NOT NULL AND compatible_make <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
    q["by_source"] = with_(*PIPE, body="SELECT website, count(*) AS n FROM uniq GROUP BY 1 ORDER BY 1")
    named = "(part_name IS NOT NULL AND part_name <> '')"
    live = f"({named} AND (({cprice('price_pkr')}) > 0 OR coalesce(available, true)))"
    q["stage_counts"] = with_("listings", body=f"""
        SELECT count(*) AS raw, count(*) FILTER (WHERE {named}) AS cleaned,
          count(*) FILTER (WHERE {named} AND NOT {live}) AS dropped,
          count(*) FILTER (WHERE {live}) AS live,
          count(DISTINCT CASE WHEN {live} AND {key_sql()} <> '' THEN {key_sql()} END) AS deduplicated
        FROM listings""")
    q["enrichment_coverage"] = with_(*PIPE, body=f"""
        SELECT count(*) FILTER (WHERE NOT ({_blank_token('compatible_make')} OR {_blank_token('part_type')})) AS valid,
               count(*) AS total FROM uniq""")
    q["known_values"] = with_(*PIPE, body="""
        SELECT DISTINCT * FROM (
          SELECT 'scraped_category' AS "column", scraped_category AS value FROM uniq
          UNION ALL SELECT 'compatible_make', compatible_make FROM uniq
          UNION ALL SELECT 'compatible_model', compatible_model FROM uniq
          UNION ALL SELECT 'part_brand', part_brand FROM uniq) WHERE value IS NOT NULL ORDER BY 1, 2""")
    return _round4(q)


# ---- scalar functions ----------------------------------------------------------

from pricewright.functions.prices import COMPAT_RANGE_PATTERN, RANGE_PATTERN  # noqa: E402

TEXTS = LISTINGS.replace("l_linenumber AS _lin, l_discount AS _disc", """l_linenumber AS _lin, l_discount AS _disc,
  CASE l_linenumber % 4
    WHEN 0 THEN concat('Rs ', format('{:,.2f}', l_extendedprice))
    WHEN 1 THEN concat('Rs. ', format('{:,.2f}', l_extendedprice))
    WHEN 2 THEN concat('Rs ', format('{:,.2f}', l_extendedprice), ' through Rs ',
                       format('{:,.2f}', round(l_extendedprice / (1 - l_discount), 2)))
    ELSE concat('Rs ', format('{:,.2f}', l_extendedprice), ' -', CAST(round(l_discount * 100) AS BIGINT), '%') END AS price_text,
  CASE WHEN l_discount >= 0.05 THEN concat('Rs ', format('{:,.2f}', round(l_extendedprice / (1 - l_discount), 2))) END AS del_text,
  CASE WHEN l_discount >= 0.05 THEN concat('Rs ', format('{:,.2f}', l_extendedprice)) END AS ins_text""")
EXTRA_CTES["texts"] = TEXTS

NUM = "[0-9][0-9,]*(?:\\.[0-9]+)?"


def money(s):
    return (f"(CASE WHEN regexp_matches({s}, '{FLOAT_LITERAL}') AND isfinite(TRY_CAST({s} AS DOUBLE)) "
            f"THEN round(TRY_CAST({s} AS DOUBLE), 2) END)")


def pprice(t, compat=False):
    if compat:
        digits = f"regexp_replace(replace({t}, ',', ''), '[^0-9.]', '', 'g')"
        return f"coalesce({money(digits)}, 0.0)"
    mark = f"regexp_extract({t}, '(?i)(?:rs\\.?|pkr|₨)\\s*({NUM})', 1)"
    first = f"regexp_extract({t}, '({NUM})', 1)"
    num = f"replace(CASE WHEN {mark} <> '' THEN {mark} ELSE {first} END, ',', '')"
    return f"coalesce({money(num)}, 0.0)"


def prange(t):
    vals = f"list_transform(regexp_extract_all(replace({t}, ',', ''), '[0-9]+(?:\\.[0-9]+)?', 0), lambda x: round(CAST(x AS DOUBLE), 2))"
    return (f"CASE WHEN len({vals}) = 0 THEN 0.0 ELSE list_min({vals}) END",
            f"CASE WHEN len({vals}) = 0 THEN 0.0 ELSE list_max({vals}) END")


def ptext(t, d, i, compat=False):
    pat = COMPAT_RANGE_PATTERN if compat else RANGE_PATTERN
    t = f"coalesce({t}, '')"
    lo, hi = prange(t)
    single = pprice(t, compat)
    is_range = f"regexp_matches({t}, '{pat}')"
    pair = f"({d} IS NOT NULL AND {i} IS NOT NULL)"
    low = f"(CASE WHEN {is_range} THEN {lo} WHEN {pair} THEN {pprice(i, compat)} ELSE {single} END)"
    high = f"(CASE WHEN {is_range} THEN {hi} WHEN {pair} THEN {pprice(d, compat)} ELSE {single} END)"
    return low, f"(CASE WHEN {high} <> {low} THEN {high} ELSE 0.0 END)"


WSC = ("[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def jtruthy(x):
    return (f"(CASE json_type({x}) WHEN 'VARCHAR' THEN json_extract_string({x}, '$') <> '' "
            f"WHEN 'BIGINT' THEN CAST(json_extract_string({x}, '$') AS DOUBLE) <> 0 "
            f"WHEN 'UBIGINT' THEN CAST(json_extract_string({x}, '$') AS DOUBLE) <> 0 "
            f"WHEN 'DOUBLE' THEN CAST(json_extract_string({x}, '$') AS DOUBLE) <> 0 "
            f"WHEN 'BOOLEAN' THEN json_extract_string({x}, '$') = 'true' "
            f"WHEN 'OBJECT' THEN CAST({x} AS VARCHAR) <> '{{}}' "
            f"WHEN 'ARRAY' THEN json_array_length({x}) > 0 ELSE false END)")


def jfloat(x):
    s = wtrim(f"json_extract_string({x}, '$')")
    return (f"(CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string({x}, '$') AS DOUBLE) "
            f"WHEN json_type({x}) = 'BOOLEAN' THEN CASE WHEN json_extract_string({x}, '$') = 'true' THEN 1.0 ELSE 0.0 END "
            f"WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({s}, '{FLOAT_LITERAL}') THEN TRY_CAST({s} AS DOUBLE) END)")


def offer_sql(js):
    """-> (price, original) SQL over a JSON text column (nested subqueries via CTE)."""
    return js


CATS = """SELECT DISTINCT split_part(p_name, ' ', 2) AS slug,
  upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS name FROM part"""
EXTRA_CTES["cats"] = CATS

CRAWL = """SELECT page_id, category_slug, url, html,
  row_number() OVER (PARTITION BY category_slug ORDER BY path_id NULLS FIRST, page_id) AS page_no,
  CASE WHEN ends_with(url, '#top') THEN 404 ELSE 200 END AS status,
  CASE WHEN html IS NULL THEN 0 ELSE (length(html) - length(replace(html, '<li', ''))) // 3 END AS n_cards
FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS category_slug,
             TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS path_id FROM pages)"""
EXTRA_CTES["crawl"] = CRAWL

DETAILS = """SELECT concat('https://shop.example/shop/', p_partkey, '-', k) AS product_url,
  CASE WHEN (p_partkey + k) % 7 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN (p_partkey + k) % 3 <> 0 THEN p_retailprice ELSE 0.0 END AS price,
  CASE WHEN p_size > 25 THEN round(p_retailprice * 1.1, 2) ELSE 0.0 END AS original_price,
  p_size % 5 <> 0 AS available,
  CASE WHEN k = 0 THEN concat('Detail ', p_name) ELSE '' END AS description
FROM part, range(4) t(k)"""
EXTRA_CTES["details"] = DETAILS

REPAIRED = f"""
SELECT c.*, d.product_url AS d_url, d.status AS d_status, d.price AS d_price, d.original_price AS d_orig,
  d.available AS d_avail, d.description AS d_desc,
  (c.price_pkr IS NULL OR c.price_pkr <= 0) AND coalesce(c.product_url, '') <> '' AS visit
FROM cleaned c LEFT JOIN details d ON c.product_url = d.product_url
  AND (c.price_pkr IS NULL OR c.price_pkr <= 0) AND coalesce(c.product_url, '') <> ''
"""
EXTRA_CTES["rj"] = REPAIRED
EXTRA_CTES["repaired"] = """
SELECT *, visit AND NOT fetched AS gone, fetched AND d_price > 0 AS fixed,
  fetched AND NOT coalesce(d_avail, true) AS oos FROM (
  SELECT *, visit AND d_url IS NOT NULL AND coalesce(d_status, 200) <> 404 AS fetched FROM rj)"""


def oracle_more() -> dict:
    q = {}
    q["parse_price"] = with_("texts", body=f"""
        SELECT {ORD}, price_text, {pprice('price_text')} AS price, {pprice('price_text', True)} AS price_compat FROM texts""")
    lo, hi = prange("price_text")
    q["parse_price_range"] = with_("texts", body=f"SELECT {ORD}, {lo} AS low, {hi} AS high FROM texts")
    a, b = ptext("price_text", "del_text", "ins_text")
    c, d = ptext("price_text", "del_text", "ins_text", True)
    q["price_text_rule"] = with_("texts", body=f"""
        SELECT {ORD}, {a} AS price, {b} AS original, {c} AS price_compat, {d} AS original_compat FROM texts""")
    found = ("list_filter(list_transform(regexp_extract_all(concat_ws(' ', description, price_text), "
             "'(?:Rs\\.?\\s*|₨\\s*)([0-9,]+(?:\\.[0-9]+)?)', 1), lambda x: " + pprice("x", True) + "), lambda v: v > 0)")
    q["currency_search"] = with_("texts", body=f"SELECT {ORD}, coalesce({found}[1], 0.0) AS price FROM texts")
    h = wtrim("CASE WHEN l_linenumber % 2 = 0 THEN concat(' /shop/', l_partkey, '/ ') ELSE product_url END")
    q["absolute_url"] = with_("listings", body=f"""
        SELECT {ORD}, CASE WHEN starts_with({h}, 'http') THEN {h} ELSE concat('https://shop.example', {h}) END AS product_url
        FROM listings""")
    q["log_target"] = with_(*PIPE, body=f"""
        SELECT {ORD}, round(ln(1 + price_pkr), 6) AS y,
          round(greatest(exp(ln(1 + price_pkr) - 1.0) - 1, 0.0), 4) AS back FROM uniq""")
    tok = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_]+', 0)"
    q["tokens"] = f"""SELECT doc_id, CAST(len({tok}) AS BIGINT) AS n_tokens,
        array_to_string({tok}, ' ') AS tokens FROM documents"""
    fenced = ("CASE WHEN turn % 3 = 0 THEN concat('```json' || chr(10), text, chr(10) || '```') "
              "WHEN turn % 3 = 1 THEN concat('  ```', text, '``` ') ELSE text END")
    t = wtrim(fenced)
    sf = (f"CASE WHEN starts_with({t}, '```') THEN regexp_replace(regexp_replace({t}, '^```(?:json)?{WSC}*', ''), "
          f"'{WSC}*```$', '') ELSE {t} END")
    q["strip_fence"] = f"SELECT conv_id, turn, {sf} AS text FROM conversations"
    js = f"""CASE l_linenumber % 4
        WHEN 0 THEN concat('{{"offers": {{"price": "', CAST(l_extendedprice AS VARCHAR), '", "highPrice": "',
                           CAST(round(l_extendedprice * 1.1, 2) AS VARCHAR), '"}}}}')
        WHEN 1 THEN concat('{{"offers": [{{"lowPrice": ', CAST(l_extendedprice AS VARCHAR), '}}]}}')
        WHEN 2 THEN concat('{{"Offers": {{"price": "', CAST(l_extendedprice AS VARCHAR), '"}}}}')
        ELSE '{{"offers": {{"price": "call us"}}}}' END"""
    q["offer_price"] = with_("listings", body=f"""
        SELECT {ORD}, coalesce(price, 0.0) AS price,
               coalesce(CASE WHEN price IS NOT NULL AND {jtruthy('hp')} THEN {jfloat('hp')} END, 0.0) AS original
        FROM (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND json_type(node) = 'OBJECT' AND {jtruthy('p')}
                             THEN {jfloat('p')} END AS price, json_extract(node, '$.highPrice') AS hp
          FROM (SELECT *, CASE WHEN {jtruthy("json_extract(node, '$.price')")} THEN json_extract(node, '$.price')
                               ELSE json_extract(node, '$.lowPrice') END AS p
            FROM (SELECT *, CASE WHEN json_type(offers) = 'ARRAY' THEN json_extract(offers, '$[0]') ELSE offers END AS node
              FROM (SELECT *, CASE WHEN {jtruthy("json_extract(j, '$.offers')")} THEN json_extract(j, '$.offers')
                                   ELSE json_extract(j, '$.Offers') END AS offers
                FROM (SELECT {ORD}, CASE WHEN json_valid(js) THEN CAST(js AS JSON) END AS j
                  FROM (SELECT *, {js} AS js FROM listings))))))""")
    pred = "price_pkr * 0.9"
    q["price_band"] = with_(*PIPE, body=f"""
        SELECT {ORD}, round_even({pred}, 0) AS predicted_price_pkr,
          round_even(greatest({pred} - 1.5 * 1222.0, 0.0), 0) AS confidence_range_low,
          round_even({pred} + 1.5 * 1222.0, 0) AS confidence_range_high FROM uniq""")
    q["category_filter"] = with_("cats", body="""
        SELECT * FROM cats WHERE contains(slug, 'al') OR contains(slug, 'ro') OR contains(slug, 'blu')""")
    q["category_names"] = with_("listings", "cleaned", "cats", body=f"""
        SELECT {ORD}, scraped_category AS category_slug, name AS scraped_category
        FROM cleaned JOIN cats ON cats.slug = cleaned.scraped_category
        WHERE contains(cats.slug, 'a') OR contains(cats.slug, 'e')""")
    q["resume_pending"] = with_("cats", body="SELECT * FROM cats WHERE NOT contains(slug, 'o')")
    q["page_prefix"] = with_("crawl", body="""
        SELECT page_id, category_slug, page_no, status, n_cards FROM crawl c
        WHERE page_no < coalesce((SELECT min(page_no) FROM crawl b
          WHERE b.category_slug = c.category_slug
            AND (b.status = 404 OR b.html IS NULL OR b.n_cards = 0)), 1000000)""")
    q["page_url"] = with_("crawl", body="""
        SELECT page_id, CASE WHEN page_no = 1 THEN concat('https://shop.example/category/', category_slug, '/')
          ELSE concat('https://shop.example/category/', category_slug, '/page/', page_no, '/') END AS page_url FROM crawl""")
    q["repair_prices"] = with_("listings", "cleaned", "details", "rj", "repaired", body=f"""
        SELECT {ORD},
          CASE WHEN fixed THEN d_price ELSE price_pkr END AS price_pkr,
          CASE WHEN fixed AND d_orig > 0 THEN d_orig ELSE price_original_pkr END AS price_original_pkr,
          CASE WHEN gone OR oos THEN false ELSE available END AS available,
          CASE WHEN fetched AND coalesce(description, '') = '' AND coalesce(d_desc, '') <> '' THEN d_desc
               ELSE description END AS description,
          CASE WHEN gone THEN '404_or_error' END AS _status
        FROM repaired""")
    q["repair_counters"] = with_("listings", "cleaned", "details", "rj", "repaired", body="""
        SELECT count(*) FILTER (WHERE visit) AS visited, count(*) FILTER (WHERE fixed) AS fixed,
          count(*) FILTER (WHERE oos) AS marked_out_of_stock, count(*) FILTER (WHERE gone) AS gone,
          count(*) FILTER (WHERE p IS NULL OR p <= 0) AS still_zero,
          count(*) FILTER (WHERE (p IS NULL OR p <= 0) AND NOT coalesce(a, true)) AS dropped
        FROM (SELECT *, CASE WHEN fixed THEN d_price ELSE price_pkr END AS p,
                        CASE WHEN gone OR oos THEN false ELSE available END AS a FROM repaired)""")
    q["repair_preview"] = with_("listings", "cleaned", body=f"""
        SELECT {ORD}, substr(part_name, 1, 60) AS part_name,
          greatest((SELECT count(*) FROM cleaned WHERE price_pkr IS NULL OR price_pkr <= 0) - 10, 0) AS remaining
        FROM cleaned WHERE price_pkr IS NULL OR price_pkr <= 0 ORDER BY {ORD} LIMIT 10""")
    after = f"""SELECT * REPLACE (
          CASE WHEN fixed THEN d_price ELSE price_pkr END AS price_pkr,
          CASE WHEN fixed AND d_orig > 0 THEN d_orig ELSE price_original_pkr END AS price_original_pkr,
          CASE WHEN gone OR oos THEN false ELSE available END AS available,
          CASE WHEN fetched AND coalesce(description, '') = '' AND coalesce(d_desc, '') <> '' THEN d_desc
               ELSE description END AS description) FROM repaired"""
    # the build again, over the rows that are kept: inner names hide the outer ones
    q["repair_pass"] = with_("listings", "cleaned", "details", "rj", "repaired", body=f"""
        SELECT f.*, c.* FROM (
          WITH cleaned AS (SELECT {ORD}, {CLEAN_COLS} FROM ({after}) WHERE price_pkr > 0 OR coalesce(available, true)),
               live AS (SELECT * FROM ({PRICED_DEDUP}) WHERE price_pkr > 0 OR available),
               uniq AS ({UNIQUE}), keyed AS ({ALTS}), pairs AS ({ALT_PAIRS}), final AS ({EXTRA_CTES["final"]})
          SELECT {ORD}, part_name, price_pkr, price_original_pkr, available, substr(description, 1, 500) AS description,
            alternatives_count FROM final) f,
        (SELECT *, total - dropped AS kept FROM (
          SELECT count(*) FILTER (WHERE visit) AS visited, count(*) FILTER (WHERE fixed) AS fixed,
            count(*) FILTER (WHERE oos) AS marked_out_of_stock, count(*) FILTER (WHERE gone) AS gone,
            count(*) FILTER (WHERE price_pkr IS NULL OR price_pkr <= 0) AS still_zero,
            count(*) FILTER (WHERE (price_pkr IS NULL OR price_pkr <= 0) AND NOT coalesce(available, true)) AS dropped,
            count(*) AS total FROM ({after}))) c""").replace("SELECT f.*, c.* FROM", "SELECT f.*, c.* EXCLUDE (total) FROM")
    return q


# ---- features ------------------------------------------------------------------

# The tokens a pandas CSV reader takes for missing.
NA_TOKENS = ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 
             'nan', 'null')

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


def na(c):
    return f"CASE WHEN {c} IN ({_NA}) OR {c} = '' THEN NULL ELSE {c} END AS {c}"


EXTRA_CTES["fv"] = f"""SELECT {ORD}, {na('part_name')}, {na('part_type')}, {na('part_brand')},
  {na('scraped_category')}, {na('compatible_make')}, {na('compatible_model')}, year_from, year_to, price_pkr,
  price_original_pkr, {na('condition')}, alternatives_count FROM final"""
EXTRA_CTES["pos"] = "SELECT * FROM fv WHERE price_pkr > 0 AND NOT isnan(price_pkr)"
EXTRA_CTES["trimmed"] = """SELECT * FROM pos WHERE price_pkr BETWEEN
  (SELECT quantile_cont(price_pkr, 0.01) FROM pos) AND (SELECT quantile_cont(price_pkr, 0.99) FROM pos)"""
FILLED = f"""SELECT {ORD}, coalesce(part_name, '') AS part_name,
  coalesce(part_type, 'Unknown') AS part_type, coalesce(part_brand, 'Unknown') AS part_brand,
  coalesce(scraped_category, 'Unknown') AS scraped_category, coalesce(compatible_make, 'Unknown') AS compatible_make,
  coalesce(compatible_model, 'Unknown') AS compatible_model, coalesce(condition, 'Unknown') AS condition,
  CAST(coalesce(year_from, 0) AS INTEGER) AS year_from, CAST(coalesce(year_to, 0) AS INTEGER) AS year_to,
  coalesce(price_original_pkr, 0.0) AS price_original_pkr, CAST(coalesce(alternatives_count, 0) AS INTEGER) AS alternatives_count,
  price_pkr FROM {{src}}"""
EXTRA_CTES["filled_pos"] = FILLED.format(src="pos")
SPW = SP
EXTRA_CTES["prep"] = f"""SELECT *, greatest(year_to - year_from, 0) AS year_span,
  CAST(year_from > 0 OR year_to > 0 AS INTEGER) AS has_year,
  CAST(lower(compatible_make) = 'universal' AS INTEGER) AS is_universal,
  CAST(price_original_pkr > 0 AS INTEGER) AS has_discount,
  CAST(len(list_filter(string_split(translate(part_name, '{WS_CHARS}', '{SPW}'), ' '), lambda x: x <> '')) AS INTEGER) AS name_word_count
FROM ({FILLED.format(src='trimmed')})"""
FEAT_PIPE = PIPE + ("keyed", "pairs", "final", "fv", "pos", "trimmed", "prep")


def _unpivot(src, cols, extra=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value{extra} FROM {src}"
                              for c in cols)


FREQ = ["compatible_make", "compatible_model", "part_brand", "scraped_category"]
MEANS = ["scraped_category", "compatible_make"]
ORDS = ["part_brand", "scraped_category", "compatible_make", "compatible_model", "condition", "part_type"]


def freq_sql(src):
    return f"""SELECT "column", value, count(*) / (SELECT count(*) FROM {src}) AS freq
        FROM ({_unpivot(src, FREQ)}) GROUP BY ALL"""


def mean_sql(src):
    return f"""SELECT "column", value, avg(y) AS mean_price FROM ({_unpivot(src, MEANS, ', price_pkr AS y')}) GROUP BY ALL
        UNION ALL SELECT '*', NULL, avg(price_pkr) FROM {src}"""


def ord_sql(src):
    return f"""SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value COLLATE "C") - 1 AS DOUBLE) AS code
        FROM (SELECT DISTINCT * FROM ({_unpivot(src, ORDS)}) WHERE value IS NOT NULL)"""


def encode_sql(src, fm, mm, om=None):
    sel = [f"coalesce((SELECT freq FROM {fm} m WHERE m.\"column\" = '{c}' AND m.value = s.{c}), 0.0) AS {c}_freq"
           for c in FREQ]
    sel += [f"ln(1 + coalesce((SELECT mean_price FROM {mm} m WHERE m.\"column\" = '{c}' AND m.value = s.{c}), "
            f"(SELECT mean_price FROM {mm} WHERE \"column\" = '*'))) AS {c}_price_mean" for c in MEANS]
    if om:
        sel += [f"coalesce((SELECT code FROM {om} m WHERE m.\"column\" = '{c}' AND m.value = s.{c}), -1.0) AS {c}_code"
                for c in ORDS]
    return f"SELECT s.*, {', '.join(sel)} FROM {src} s"


def _hash_split():
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in ORD.split(", ")) + ")"
    return (f"CASE WHEN CAST(('0x' || substr(md5(concat('42:', {key})), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2 "
            "THEN 'test' ELSE 'train' END")


EXTRA_CTES["sp"] = f"SELECT *, {_hash_split()} AS split FROM prep"
EXTRA_CTES["tr"] = "SELECT * FROM sp WHERE split = 'train'"
EXTRA_CTES["fm_all"] = freq_sql("prep")
EXTRA_CTES["mm_all"] = mean_sql("prep")
EXTRA_CTES["om_all"] = ord_sql("prep")
EXTRA_CTES["fm_tr"] = freq_sql("tr")
EXTRA_CTES["mm_tr"] = mean_sql("tr")
EXTRA_CTES["om_tr"] = ord_sql("tr")
ENG = ["year_span", "has_year", "is_universal", "has_discount", "name_word_count",
       "compatible_make_freq", "compatible_model_freq", "part_brand_freq", "scraped_category_freq",
       "scraped_category_price_mean", "compatible_make_price_mean"]


def oracle_features() -> dict:
    q = {}
    q["trim_outliers"] = with_(*FEAT_PIPE[:-1], body=f"SELECT {ORD}, price_pkr FROM trimmed")
    q["fill_missing"] = with_(*FEAT_PIPE[:-2], "filled_pos", body=f"""SELECT {ORD}, part_brand, scraped_category,
        compatible_make, compatible_model, condition, part_type, year_from, year_to, price_original_pkr,
        alternatives_count FROM filled_pos""")
    q["engineered_features"] = with_(*FEAT_PIPE, body=f"""SELECT {ORD}, year_span, has_year, is_universal,
        has_discount, name_word_count FROM prep""")
    q["frequency_maps"] = with_(*FEAT_PIPE, "fm_all", body="SELECT * FROM fm_all")
    q["price_mean_maps"] = with_(*FEAT_PIPE, "mm_all", body="SELECT * FROM mm_all")
    q["lookup_encode"] = with_(*FEAT_PIPE, "fm_all", "mm_all", body=f"""SELECT {ORD},
        {', '.join(c + '_freq' for c in FREQ)}, {', '.join(c + '_price_mean' for c in MEANS)}
        FROM ({encode_sql('prep', 'fm_all', 'mm_all')})""")
    q["group_mean_transform"] = with_(*FEAT_PIPE, body=f"""SELECT {ORD},
        avg(price_pkr) OVER (PARTITION BY scraped_category) AS category_mean FROM prep""")
    q["ordinal_encode"] = with_(*FEAT_PIPE, "fm_all", "mm_all", "om_all", body=f"""SELECT {ORD}, {', '.join(c + '_code' for c in ORDS)}
        FROM ({encode_sql('prep', 'fm_all', 'mm_all', 'om_all')})""")
    q["split_assign"] = with_(*FEAT_PIPE, "sp", body=f"SELECT {ORD}, split FROM sp")
    q["features"] = with_(*FEAT_PIPE, "sp", "tr", "fm_tr", "mm_tr", "om_tr", body=f"""SELECT {ORD}, split, price_pkr,
        {', '.join(c + '_code' for c in ORDS)}, year_from, year_to, price_original_pkr, alternatives_count,
        {', '.join(ENG)} FROM ({encode_sql('sp', 'fm_tr', 'mm_tr', 'om_tr')})""")
    q["serving_features"] = with_(*FEAT_PIPE, "sp", "tr", "fm_tr", "mm_tr", "om_tr", body=f"""SELECT {ORD},
        {', '.join(c + '_code' for c in ORDS)}, {', '.join(ENG[5:])}
        FROM ({encode_sql("(SELECT * FROM sp WHERE split = 'test')", 'fm_tr', 'mm_tr', 'om_tr')})""")
    q["price_stats"] = with_(*FEAT_PIPE, body="""SELECT round(avg(price_pkr), 2) AS mean,
        round(quantile_cont(price_pkr, 0.5), 2) AS median, round(min(price_pkr), 2) AS min,
        round(max(price_pkr), 2) AS max, round(stddev_samp(price_pkr), 2) AS std FROM prep""")
    return q


# ---- evaluation -------------------------------------------------------------------


def base_sql(col):
    return f"""SELECT sp.*, price_pkr AS actual, coalesce(m.mp, (SELECT avg(price_pkr) FROM tr)) AS predicted
        FROM sp LEFT JOIN (SELECT {col}, avg(price_pkr) AS mp FROM tr GROUP BY 1) m USING ({col})"""


EXTRA_CTES["pred_cat"] = base_sql("scraped_category")
EXTRA_CTES["pred_make"] = base_sql("compatible_make")
EXTRA_CTES["pred_brand"] = base_sql("part_brand")


def metrics_sql(src, where="split = 'test'", single_zero=False):
    r2 = """CASE WHEN var_pop(actual) * count(*) = 0 THEN CASE WHEN sum((predicted - actual)^2) = 0 THEN 1.0 ELSE 0.0 END
              ELSE 1 - sum((predicted - actual)^2) / (var_pop(actual) * count(*)) END"""
    if single_zero:
        r2 = f"CASE WHEN count(*) > 1 THEN {r2} ELSE 0.0 END"
    return f"""count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual)^2)) AS rmse,
        {r2} AS r2, avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS mape,
        quantile_cont(abs(predicted - actual), 0.5) AS median_ae"""


EVAL = FEAT_PIPE + ("sp", "tr")


def oracle_eval() -> dict:
    q = {}
    q["regression_metrics"] = with_(*EVAL, "pred_cat", body=f"SELECT {metrics_sql('')} FROM pred_cat WHERE split = 'test'")
    q["bucket_metrics"] = with_(*EVAL, "pred_cat", body=f"""SELECT bucket, {metrics_sql('', single_zero=True)} FROM (
        SELECT *, CASE WHEN actual >= 0 AND actual < 2000 THEN 'Rs 0 – 2,000'
          WHEN actual >= 2000 AND actual < 5000 THEN 'Rs 2,000 – 5,000'
          WHEN actual >= 5000 AND actual < 15000 THEN 'Rs 5,000 – 15,000'
          WHEN actual >= 15000 AND actual < 50000 THEN 'Rs 15,000 – 50,000'
          WHEN actual >= 50000 THEN 'Rs 50,000+' END AS bucket FROM pred_cat WHERE split = 'test')
        WHERE bucket IS NOT NULL GROUP BY bucket""")
    for name, col, n in [("error_by_category", "scraped_category", 15), ("error_by_make", "compatible_make", 10)]:
        q[name] = with_(*EVAL, "pred_cat", body=f"""SELECT {col} AS value, count(*) AS n,
            avg(least(abs(predicted - actual) / actual * 100, 500.0)) AS mape, avg(abs(predicted - actual)) AS mae
            FROM pred_cat GROUP BY 1 ORDER BY n DESC, value LIMIT {n}""")
    q["sample_predictions"] = with_(*EVAL, "pred_cat", body=f"""SELECT substr(part_name, 1, 45) AS name, actual, predicted,
        predicted - actual AS error, (predicted - actual) / actual * 100 AS pct_error
        FROM pred_cat WHERE split = 'test' ORDER BY {ORD} LIMIT 15""")
    m = " UNION ALL ".join(
        f"SELECT 'mean_by_{c}' AS model, {i} AS rank, (SELECT r2 FROM (SELECT {metrics_sql('')} FROM pred_{t} WHERE split = 'test')) AS r2"
        for i, (c, t) in enumerate([("scraped_category", "cat"), ("compatible_make", "make"), ("part_brand", "brand")]))
    q["select_best"] = with_(*EVAL, "pred_cat", "pred_make", "pred_brand", body=f"""
        SELECT arg_max(model, r2 * 1e6 - rank) AS best, max(r2) AS best_r2 FROM ({m})""")
    return q


# ---- text features --------------------------------------------------------------

def _stop_sql():
    from pricewright.operators.tfidf import stop_words
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"


def toks_sql(col):
    return (f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_][\\p{{L}}\\p{{M}}\\p{{N}}_]+', 0), "
            f"lambda t: NOT list_contains({_stop_sql()}, t))")


TERMS = ("list_concat(tk, CASE WHEN len(tk) >= 2 THEN list_transform(range(1, len(tk)), "
         "lambda i: tk[i] || ' ' || tk[i + 1]) ELSE [] END)")


def vocab_sql(src):
    return f"""SELECT term, df, tf, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf,
        row_number() OVER (ORDER BY term COLLATE "C") - 1 AS "index" FROM (
      SELECT d.term, d.df, t.tf, (SELECT count(*) FROM {src}) AS n FROM
        (SELECT term, count(*) AS df FROM (SELECT DISTINCT rid, unnest(terms) AS term FROM {src}) GROUP BY 1) d
        JOIN (SELECT term, count(*) AS tf FROM (SELECT unnest(terms) AS term FROM {src}) GROUP BY 1) t USING (term)
      WHERE d.df >= 2 AND d.df <= (SELECT count(*) FROM {src}) * 0.95
      ORDER BY t.tf DESC, d.term COLLATE "C" LIMIT 300)"""


EXTRA_CTES["docs"] = f"""SELECT *, {TERMS} AS terms FROM (
    SELECT {ORD}, split, concat_ws('|', {ORD}) AS rid, {toks_sql('part_name')} AS tk FROM sp)"""
EXTRA_CTES["tdocs"] = "SELECT * FROM docs WHERE split = 'train'"
EXTRA_CTES["vocab"] = vocab_sql("tdocs")
EXTRA_CTES["ddocs"] = f"""SELECT *, {TERMS} AS terms FROM (
    SELECT doc_id, doc_id AS rid, {toks_sql('text')} AS tk FROM documents)"""


def oracle_text() -> dict:
    q = {}
    q["tfidf_vocab"] = with_(*FEAT_PIPE, "sp", "docs", "tdocs", "vocab", body="SELECT * FROM vocab")
    q["feature_count"] = with_(*FEAT_PIPE, "sp", "docs", "tdocs", "vocab", body="""
        SELECT (SELECT count(*) FROM prep) AS n_rows, CAST(21 AS BIGINT) AS n_base, count(*) AS n_text,
          21 + count(*) AS n_features
        FROM vocab""")
    q["tfidf_documents"] = with_("ddocs", body=f"SELECT * FROM ({vocab_sql('ddocs')})")
    q["tfidf_weights"] = with_(*FEAT_PIPE, "sp", "docs", "tdocs", "vocab", body=f"""
        SELECT {ORD}, term, "index", raw / sqrt(sum(raw * raw) OVER (PARTITION BY {ORD})) AS weight FROM (
          SELECT c.*, v."index", c.n * v.idf AS raw FROM
            (SELECT {ORD}, term, count(*) AS n FROM (SELECT {ORD}, unnest(terms) AS term FROM docs) GROUP BY ALL) c
            JOIN vocab v USING (term))""")
    return q


# ---- enrichment ------------------------------------------------------------------

from pricewright.operators.enrich import INSTRUCTIONS  # noqa: E402

_KEY = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in ORD.split(", ")) + ")"
EXTRA_CTES["todo"] = f"""SELECT * FROM uniq WHERE {_blank_token('compatible_make')} OR {_blank_token('part_type')}"""
EXTRA_CTES["batched"] = f"""SELECT *, place // 15 AS batch_id, CAST(place % 15 AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (ORDER BY substr(md5({_KEY}), 1, 4), {ORD}) - 1 AS place FROM todo)"""
EXTRA_CTES["shaped"] = """SELECT *, l_partkey % 4 AS v, batch_id % 7 = 3 AS bare FROM batched"""


def oracle_enrich() -> dict:
    q = {}
    enr = PIPE + ("todo", "batched")
    q["enrichment_batches"] = with_(*enr, body=f"SELECT {ORD}, batch_id, pos FROM batched")
    instr = INSTRUCTIONS.replace("'", "''")
    q["enrichment_prompts"] = with_(*enr, body=f"""
        SELECT batch_id, count(*) AS n_parts,
          replace('{instr}', '{{n}}', CAST(count(*) AS VARCHAR))
            || string_agg(printf('%d. Name: "%s", Category: "%s"', pos + 1, part_name, coalesce(scraped_category, '')),
                          chr(10) ORDER BY pos) AS prompt
        FROM batched GROUP BY batch_id""")
    q["parse_responses"] = with_(*enr, "shaped", body="""
        SELECT batch_id, pos,
          CASE WHEN v = 0 THEN concat('B-', l_suppkey % 10) END AS part_brand,
          CASE WHEN v = 0 THEN concat('Make ', l_partkey % 7) END AS compatible_make,
          CASE WHEN v = 0 THEN CAST(l_linenumber + 2000 AS VARCHAR) WHEN v = 2 THEN '2017.9' END AS year_from
        FROM shaped WHERE NOT bare AND v IN (0, 1, 2)
        UNION ALL
        SELECT batch_id, CAST(count(*) AS INTEGER) AS pos, NULL, NULL, NULL FROM shaped
        WHERE NOT bare AND batch_id % 6 = 1 GROUP BY batch_id""")
    hit = "(NOT bare AND v IN (0, 1, 2))"
    q["merge_responses"] = with_(*enr, "shaped", body=f"""
        SELECT {ORD},
          CASE WHEN NOT {hit} THEN part_brand WHEN v = 0 THEN concat('B-', l_suppkey % 10) WHEN v = 2 THEN ''
               ELSE part_brand END AS part_brand,
          CASE WHEN NOT {hit} THEN part_type WHEN v = 0 THEN split_part(part_name, ' ', 2) WHEN v = 1 THEN 'Filter'
               ELSE part_type END AS part_type,
          CASE WHEN NOT {hit} THEN compatible_make WHEN v = 0 THEN concat('Make ', l_partkey % 7) ELSE '' END AS compatible_make,
          CASE WHEN NOT {hit} THEN compatible_model WHEN v = 0 THEN concat('Model ', l_suppkey % 3) ELSE '' END AS compatible_model,
          CASE WHEN NOT {hit} THEN year_from WHEN v = 0 THEN CASE WHEN l_linenumber + 2000 BETWEEN 1980 AND 2030 THEN l_linenumber + 2000 END
               WHEN v = 2 THEN 2017 END AS year_from,
          CASE WHEN NOT {hit} THEN year_to WHEN v = 0 THEN CASE WHEN l_linenumber + 2010 BETWEEN 1980 AND 2030 THEN l_linenumber + 2010 END
               END AS year_to,
          CASE WHEN NOT {hit} THEN condition WHEN v = 0 THEN 'Used' WHEN v = 1 THEN 'New' ELSE '' END AS condition,
          {hit} AS enriched
        FROM shaped""")
    return q


# ---- scoring requests ----------------------------------------------------------


def oracle_score() -> dict:
    q = {}
    req = f"""SELECT {ORD}, part_name, part_type, part_brand, scraped_category, compatible_make, compatible_model,
        CASE WHEN l_linenumber = 7 THEN 2099 ELSE year_from END AS year_from, year_to, price_original_pkr,
        CAST(NULL AS INTEGER) AS alternatives_count, condition FROM cleaned"""
    EXTRA_CTES["req"] = req
    lim = {"part_name": 300, "part_type": 200, "part_brand": 100, "scraped_category": 100,
           "compatible_make": 100, "compatible_model": 100}
    rules = ["CASE WHEN part_name IS NULL THEN 'part_name_missing' END",
             "CASE WHEN part_name IS NOT NULL AND length(part_name) < 1 THEN 'part_name_empty' END"]
    rules += [f"CASE WHEN length({c}) > {n} THEN '{c}_too_long' END" for c, n in lim.items()]
    rules += [f"CASE WHEN {c} < 0 OR {c} > 2030 THEN '{c}_out_of_range' END" for c in ["year_from", "year_to"]]
    rules += [f"CASE WHEN {c} < 0 THEN '{c}_negative' END" for c in ["price_original_pkr", "alternatives_count"]]
    arr = "list_filter([" + ", ".join(rules) + "], lambda x: x IS NOT NULL)"
    q["validate_requests"] = with_("listings", "cleaned", "req", body=f"""
        SELECT {ORD}, len({arr}) = 0 AS valid, array_to_string({arr}, ',') AS violations FROM req""")
    d = {"part_type": "Unknown", "part_brand": "Unknown", "scraped_category": "Unknown",
         "compatible_make": "Universal", "compatible_model": "Universal", "condition": "New"}
    sel = ", ".join(f"coalesce(CASE WHEN {c} <> '' THEN {c} END, '{v}') AS {c}" for c, v in d.items())
    q["request_defaults"] = with_("listings", "cleaned", "req", body=f"""
        SELECT {ORD}, {sel}, CAST(coalesce(year_from, 0) AS INTEGER) AS year_from,
          CAST(coalesce(year_to, 0) AS INTEGER) AS year_to, CAST(coalesce(alternatives_count, 0) AS INTEGER) AS alternatives_count
        FROM req""")
    return q


# The default categories, in source order.
CATEGORIES = """SELECT * FROM (VALUES
    (0, 'car-parts/back-lights', 'Back Lights'),
    (1, 'car-parts/head-lights', 'Head Lights'),
    (2, 'car-parts/mud-flap', 'Mud Flaps'),
    (3, 'car-parts/side-mirrors', 'Side Mirrors'),
    (4, 'car-parts/spark-plugs', 'Spark Plugs'),
    (5, 'car-parts/wiper-blades', 'Wiper Blades'),
    (6, 'car-filters/ac-filter', 'AC Cabin Filter'),
    (7, 'car-filters/air-filters', 'Air Filter'),
    (8, 'car-filters/fuel-filter', 'Fuel Filter'),
    (9, 'car-filters/oil-filters', 'Oil Filter'),
    (10, 'oils-and-additives/brake-oils', 'Brake Oil'),
    (11, 'oils-and-additives/engine-oil', 'Engine Oil'),
    (12, 'oils-and-additives/oil-additives', 'Oil Additives'),
    (13, 'oils-and-additives/steering-oil', 'Steering Oil'),
    (14, 'oils-and-additives/transmission-oils', 'Transmission Oil'),
    (15, 'car-accessories/mats/floor-mats', 'Floor Mats'),
    (16, 'car-accessories/mats/dash-mats', 'Dash Mats'),
    (17, 'car-accessories/interior-accessories/seat-covers-and-cushions', 'Seat Covers'),
    (18, 'car-accessories/interior-accessories/steering-wheel-accessories', 'Steering Accessories'),
    (19, 'car-accessories/interior-accessories/sun-shades', 'Sun Shades'),
    (20, 'car-accessories/exterior-accessories/top-covers', 'Car Top Covers'),
    (21, 'car-accessories/exterior-accessories/body-kits', 'Body Kits'),
    (22, 'car-accessories/exterior-accessories/chrome-products', 'Chrome Parts'),
    (23, 'car-accessories/exterior-accessories/horns', 'Horns'),
    (24, 'car-accessories/exterior-accessories/mufflers', 'Mufflers'),
    (25, 'car-accessories/exterior-accessories/performance-parts', 'Performance Parts'),
    (26, 'car-accessories/exterior-accessories/airpress', 'Air Press / Wind Deflectors'),
    (27, 'led-lights/drl-fog-lamps', 'DRL & Fog Lamps'),
    (28, 'led-lights/hid-led-smd-lights', 'HID / LED / SMD Lights'),
    (29, 'led-lights/led-head-lights', 'LED Head Lights'),
    (30, 'led-lights/led-tail-lights', 'LED Tail Lights'),
    (31, 'car-electronics/car-camera', 'Car Cameras'),
    (32, 'car-electronics/stereo-systems', 'Stereo Systems'),
    (33, 'car-electronics/speakers-and-amplifiers', 'Speakers & Amplifiers'),
    (34, 'car-electronics/security-systems', 'Security Systems'),
    (35, 'tyres-and-wheels/tyres', 'Tyres'),
    (36, 'tyres-and-wheels/wheel-covers', 'Wheel Covers'),
    (37, 'batteries', 'Batteries'),
    (38, 'tools/basic-tools', 'Basic Tools'),
    (39, 'tools/tool-kits', 'Tool Kits'),
    (40, 'tools/air-compressor', 'Air Compressors'),
    (41, 'tools/cable-and-jump-starter', 'Jump Starters'),
    (42, 'car-care/carcare-exterior/tire-care', 'Tire Care Products'),
    (43, 'car-care/coolants', 'Coolants')) t(place, slug, name)"""


def oracle_pages() -> dict:
    q = {}
    a, b = ptext("price_text", "del_text", "ins_text")
    avail = "available"
    q["listing_cards"] = with_("texts", body=f"""
        SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS card_no,
          split_part(trim(part_name), '  ', 1) AS part_name,
          concat('https://shop.example/shop/', l_partkey, '-', l_suppkey % 4) AS product_url,
          {a} AS price_pkr, {b} AS price_original_pkr, {avail} AS available
        FROM texts""")
    q["raw_listings"] = f"""
        SELECT c.page_id, c.card_no, c.part_name, k.name AS scraped_category, k.slug AS category_slug, c.price_pkr,
          c.price_original_pkr, c.available, c.product_url, 'shop.example' AS website,
          'https://shop.example' AS source_base, '' AS part_brand, '' AS part_type, '' AS compatible_make,
          '' AS compatible_model, CAST(NULL AS INTEGER) AS year_from, CAST(NULL AS INTEGER) AS year_to,
          'New' AS condition, '' AS description
        FROM ({q["listing_cards"]}) c JOIN ({CATEGORIES}) k ON c.page_id % 46 = k.place"""
    q["detail_skus"] = with_("listings", body=f"""
        SELECT {ORD}, CASE WHEN l_linenumber < 7 THEN concat('K-', l_partkey) END AS sku FROM listings""")
    layout = "l_linenumber % 6"     # sale pair, amount, JSON-LD, meta tag, currency text, sold out
    detail = """SELECT {ORD}, CASE WHEN {k} {priced} THEN l_extendedprice ELSE 0.0 END AS price,
          {original} AS original_price, {k} <> 5 AS available, trim(part_name) AS description FROM listings"""
    q["detail_prices"] = with_("listings", body=detail.format(
        ORD=ORD, k=layout, priced="<> 5",
        original=f"CASE WHEN {layout} = 0 THEN round(l_extendedprice * 1.2 * 100) / 100 ELSE 0.0 END"))
    q["detail_prices_inline"] = with_("listings", body=detail.format(ORD=ORD, k=layout, priced="< 3", original="0.0"))
    q["page_detail_robustness"] = "SELECT page_id, 0.0 AS price, 0.0 AS original_price FROM pages"
    return q
