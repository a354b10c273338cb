"""Secret scan in DataFrame functions only.

Base spans come from three fixed patterns. Further candidates are runs of key
characters; two character Markov models, one of random strings and one of
ordinary identifiers, give each a log-likelihood ratio per character, and those
above a threshold are added.

The models are bigram counts of labelled samples. Values of base spans are the
random strings. Ordinary are words of 14 letters or more, and identifiers that
are put together from words of the texts, dates, times, counters and digests in
the common ways of naming files, records and variables. Each kind is at most
``max_samples`` distinct strings chosen by hash. A fifth of each is held out of
the counts, and the threshold is the larger of the given one and what all but a
thousandth of the held-out identifiers stay below; where that would miss most
held-out random strings, the kinds cannot be told apart and no span is added.

Positions are code points. A regular expression that ends each match with the
pattern and starts at the end of the last one (\\G) yields gap and match in
order, so running lengths give positions without any Python. Running values are
folded in blocks, so that a text with very many matches stays cheap.

Defined results: a null text is empty and has no spans. Without samples of both
kinds no span is added. Duplicate rows are scanned each; columns of the input
that bear an output's name are replaced. An added span never overlaps a base
span. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import stage, table

# The base patterns.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{16,}"     # as AKIA[A-Z0-9]+ with 20 characters or more: a run is matched whole
HEX = "[0-9a-f]{24,}"            # likewise
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
MAX_SAMPLES = 5000
THRESHOLD = 0.1          # nats per character by which the random model must be better, at least
BLOCK = 64               # elements of an array that are folded together
SPAN = "array<struct<start:int,end:int,kind:int>>"


def _matches(text: Column, before: str, value: str) -> Column:
    """Array of (gap and opening, value) lengths and the value, per match in order."""
    gap = F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?)({before})({value})"), F.lit(1))
    head = F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?)({before})({value})"), F.lit(2))
    tail = F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?)({before})({value})"), F.lit(3))
    return F.arrays_zip(gap.alias("g"), head.alias("h"), tail.alias("v"))


def _let(value: Column, body) -> Column:
    """Bind a value once, so that lambdas inside ``body`` do not compute it anew."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state before, item) for each item, the state moving on by step(state, item). A fold that
    grows one array copies it at every item; here blocks grow one by one and are joined at the end."""
    def block(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out")),
                           lambda acc, x: F.struct(step(acc["s"], x).alias("s"),
                                                   F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out")))

    def whole(f: Column) -> Column:
        begin = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / BLOCK).cast("int")), begin, lambda acc, b: _let(
            block(acc["s"], F.slice(f, b * BLOCK + 1, BLOCK)),
            lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))["out"]
    return _let(items, lambda f: F.when(F.size(f) > 0, F.flatten(whole(f))).otherwise(F.array().cast(f"array<{kind}>")))


def _place(found: Column) -> Column:
    """Running positions: array of (start, end, value)."""
    size = lambda m: F.char_length(m["g"]) + F.char_length(m["h"]) + F.char_length(m["v"])
    return _running(found, F.lit(0), lambda at, m: at + size(m), lambda at, m: F.struct(
        (at + F.char_length(m["g"])).alias("start"), (at + size(m)).alias("end"), m["v"].alias("value")),
        "struct<start:int,end:int,value:string>")


def find_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Add base (spans with their values) and candidates (start, end, value)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # texts without any opening of a kind skip its pattern
    scan = lambda needs, before, value: F.when(
        text.rlike(needs), _place(_matches(text, before, value))).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))
    assign = F.filter(scan(ASSIGN + VALUE, ASSIGN, VALUE), lambda s: F.char_length(s["value"]) >= 6)
    kinds = [assign, scan(ACCESS, "", ACCESS), scan(HEX, "", HEX)]
    base = F.array_sort(F.concat(*[F.transform(k, _tagged(i)) for i, k in enumerate(kinds)]))
    out = docs.withColumn("_pw_base", base).withColumn("_pw_cand", scan(CANDIDATE, "", CANDIDATE))
    # a run that holds a key or digest overlaps its span; what is left can only meet an assignment
    plain = F.filter("_pw_cand", lambda c: ~c["value"].rlike(f"{ACCESS}|{HEX}"))
    assigned = F.filter("_pw_base", lambda b: b["kind"] == 0)
    return out.withColumn("_pw_cand", F.when(F.size(plain) > 0, _let(assigned, lambda a: F.filter(plain, lambda c: ~F.exists(
        a, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))).otherwise(plain))


def _tagged(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                              s["value"].alias("value"))


def _bigrams(samples: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters by place in the alphabet (0: none of it)."""
    pairs = samples.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length("value") - 1, F.lit(1))), lambda i: F.substring("value", i, F.lit(2))
    )).alias("p")).filter(F.char_length("p") == 2)
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    rows = (pairs.groupBy("p").count().groupBy(code(F.substring("p", 1, 1)).alias("a"), code(F.substring("p", 2, 1)).alias("b"))
            .agg(F.sum("count").alias("n")).collect())
    return {(r.a, r.b): r.n for r in rows}


def identifiers(words: Column, number: Column) -> Column:
    """Ordinary identifiers of a text: its words and a number in the usual forms of names."""
    w = lambda k: F.get(words, F.pmod(F.shiftright(number, k), F.size(words)).cast("int"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (number % 9490).cast("int"))
    date, dashed = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd")
    time = F.concat(*[F.lpad(((F.shiftright(number, k)) % m).cast("string"), 2, "0") for k, m in ((3, 24), (7, 60), (11, 60))])
    count = F.lpad((number % 1_000_000).cast("string"), 6, "0")
    md5 = F.md5(number.cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    line = lambda *parts: F.concat_ws("_", *parts)
    return F.array(line(F.upper(F.substring(w(0), 1, 3)), date, time), line(w(1), date, F.concat(F.lit("v"), (number % 10).cast("string"))),
                   F.concat(date, F.lit("T"), time, F.lit("Z")), line(w(2), w(5), count), F.concat_ws("-", w(3), w(6), dashed),
                   F.concat(w(4), F.initcap(w(7)), F.initcap(w(8))), F.concat_ws("/", w(2), w(9), line(w(1), count)),
                   line(F.upper(w(0)), F.upper(w(6))), uuid)


def train(random: DataFrame, ordinary: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each character after each, smoothed; None if a
    sample is empty. Samples have a column ``value``."""
    import math
    counts = [_bigrams(random), _bigrams(ordinary)]
    if not counts[0] or not counts[1]:
        return None
    size = len(ALPHABET) + 1
    logs = []
    for c in counts:
        rows = [sum(c.get((a, b), 0) for b in range(size)) for a in range(size)]
        logs.append([math.log((c.get((a, b), 0) + 0.5) / (rows[a] + 0.5 * size))
                     for a in range(size) for b in range(size)])
    return [x - y for x, y in zip(*logs)]


def _ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair."""
    size = len(ALPHABET) + 1
    table_ = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(
            F.element_at(table_, acc["last"] * size + c + 1))).alias("sum"))
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).cast("double").alias("sum"))
    return F.aggregate(codes, zero, step)["sum"] / F.greatest(F.char_length(value) - 1, F.lit(1))


def fit(random: DataFrame, ordinary: DataFrame) -> tuple[list[float] | None, float]:
    """The model of four fifths of the samples, and the threshold from the others."""
    random, ordinary = stage(random, "secret-samples"), stage(ordinary, "secret-samples")
    held = F.pmod(F.xxhash64("value", F.lit("held out")), F.lit(5)) == 0
    model = train(random.filter(~held), ordinary.filter(~held))
    if model is None:
        return None, 0.0
    score = lambda rows, q: rows.filter(held & (F.char_length("value") >= 16)).agg(
        F.percentile(_ratio(F.col("value"), model), q)).first()[0]       # of at most max_samples strings
    limit, half = score(ordinary, 0.999), score(random, 0.5)
    if limit is not None and half is not None and half < limit:
        return None, 0.0
    return model, max(0.0, limit or 0.0)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 max_samples: int = MAX_SAMPLES, model: list[float] | None = None, keep_text: bool = False,
                 others: list[str] | None = None) -> DataFrame:
    """(id, all_spans array<struct<start,end,kind>>, n_assign, n_access, n_hex, n_markov,
    base_sha256, spans) of every row; kind is a place in KINDS."""
    # with keep_text, the text and the other columns (inside one struct, so names cannot clash) travel along
    kept = ([F.col("text").alias("_pw_text"), F.col("_pw_other")] if keep_text else [])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*[F.col(f"`{c}`") for c in others or []] or [F.lit(0)]).alias("_pw_other")]
                         if keep_text else []))
    seen = stage(find_spans(rows, "text").select("doc_id", *kept, "_pw_base", "_pw_cand",
                         F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")),
                                                               F.lit("[A-Za-z]{14,}"), F.lit(0)))
                         .alias("_pw_words")), "secret-spans")
    if model is None:
        bounded = lambda values: (values.filter("value <> ''").distinct()
                                  .orderBy(F.xxhash64("value"), "value").limit(max_samples))
        named = (rows.select("text").filter("text <> ''").orderBy(F.xxhash64("text"), "text").limit(max_samples // 4)
                 .select(F.regexp_extract_all("text", F.lit("\\b[a-z]{3,10}\\b"), F.lit(0)).alias("w"), F.crc32("text").alias("n")))
        made = named.filter(F.size("w") > 7).select(F.explode(identifiers(F.col("w"), F.col("n"))).alias("value"))
        words = bounded(seen.select(F.explode("_pw_words").alias("value")))
        model, limit = fit(bounded(seen.select(F.explode("_pw_base.value").alias("value"))), bounded(words.union(bounded(made))))
        threshold = max(threshold, limit)
    empty = F.array().cast(SPAN)
    shape = lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("kind"))
    added = empty if model is None else F.transform(
        F.filter("_pw_cand", lambda c: _ratio(c["value"], model) >= threshold), lambda s: shape(s, F.lit(3)))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("_pw_all", lambda s: s["kind"] == k)).cast("long")
    base = F.transform("_pw_base", lambda s: shape(s, s["kind"]))
    return (seen.withColumn("_pw_all", F.array_sort(F.concat(base, added), _by_start_then_kind))
            .select("doc_id", *(["_pw_text", "_pw_other"] if keep_text else []), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(text(F.array_sort(base, _by_start_then_kind)), 256).alias("base_sha256"),
                    text(F.col("_pw_all")).alias("spans"), count(3).alias("n_markov"),
                    F.col("_pw_all").alias("all_spans")))


def _by_start_then_kind(a: Column, b: Column) -> Column:
    x, y = (F.struct(s["start"], s["kind"], s["end"]) for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """Text with every covered run of characters replaced by the mask; spans sorted by start."""
    pieces = _running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(
        s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mask))).otherwise(""), "string")
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.char_length(text)))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]",
                   length_col: str | None = None) -> DataFrame:
    """``docs`` with the same rows and columns, secrets masked in the text. Rows
    without any are unchanged, null texts stay null; ``length_col``, if given,
    is set to the new length of a changed text."""
    found = scan_secrets(docs, id_col, text_col, keep_text=True, others=[c for c in docs.columns
                                                                        if c not in (id_col, text_col)])
    text = F.when(F.size("all_spans") > 0, redact(F.col("_pw_text"), F.col("all_spans"), mask)).otherwise(F.col("_pw_text"))
    out = found.withColumn("_pw_new", text)
    cols = []
    for c in docs.columns:
        if c == id_col:
            cols.append(F.col("doc_id").alias(c))
        elif c == text_col:
            cols.append(F.col("_pw_new").alias(c))
        elif c == length_col:
            cols.append(F.when(F.size("all_spans") > 0, F.char_length("_pw_new").cast("long"))
                        .otherwise(F.col(f"_pw_other.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"_pw_other.`{c}`").alias(c))
    return out.select(*cols)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
