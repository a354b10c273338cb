"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each runs over the whole test tables (or frames Spark derives from them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.functions import (clean_price, clean_str, clean_year, needs_enrichment,
                                   needs_make, ws_trim)
from pricewright.functions.prices import round2
from pricewright.operators import clean as C
from pricewright.operators import dedupe as DD
from pricewright.operators import stats as ST
from pricewright.operators.alternatives import build_alternatives, explode_alternatives
from pricewright.plans import build as B
from pricewright.sources.listings import ORD_COLS

REGISTRY: dict = {}

# Output columns of computed doubles, rounded to 4 decimals in the registered
# result (and in its oracle) so that summation order cannot change a value.
ROUND4 = {
    "frequency_maps": ["freq"], "price_mean_maps": ["mean_price"],
    "lookup_encode": ["compatible_make_freq", "compatible_model_freq", "part_brand_freq",
                      "scraped_category_freq", "scraped_category_price_mean", "compatible_make_price_mean"],
    "group_mean_transform": ["category_mean"],
    "features": ["compatible_make_freq", "compatible_model_freq", "part_brand_freq", "scraped_category_freq",
                 "scraped_category_price_mean", "compatible_make_price_mean"],
    "serving_features": ["compatible_make_freq", "compatible_model_freq", "part_brand_freq",
                         "scraped_category_freq", "scraped_category_price_mean", "compatible_make_price_mean"],
    "regression_metrics": ["mae", "rmse", "r2", "mape", "median_ae"],
    "bucket_metrics": ["mae", "rmse", "r2", "mape", "median_ae"],
    "error_by_category": ["mape", "mae"], "error_by_make": ["mape", "mae"],
    "select_best": ["best_r2"], "tfidf_vocab": ["idf"], "tfidf_documents": ["idf"], "tfidf_weights": ["weight"],
    "sample_predictions": ["predicted", "error", "pct_error"],
}


def query(fn):
    cols = ROUND4.get(fn.__name__)
    if cols:
        from pricewright.functions.prices import round_n

        def rounded(spark, d, _fn=fn, _cols=cols):
            df = _fn(spark, d)
            return df.select(*[round_n(c, 4).alias(c) if c in _cols else F.col(c) for c in df.columns])
        rounded.__name__ = fn.__name__
        REGISTRY[fn.__name__] = rounded
        return fn
    REGISTRY[fn.__name__] = fn
    return fn


def _no_alts(df):
    return df.drop("alternatives")


# ---- projections and filters -------------------------------------------

@query
def clean_strings(spark, d):
    r = B.raw(spark, d)
    return r.select(*ORD_COLS, clean_str("part_name").alias("part_name"),
                    clean_str("part_type").alias("part_type"),
                    clean_str("description").alias("description"),
                    ws_trim("part_name").alias("name_stripped"))


@query
def clean_prices(spark, d):
    r = B.raw(spark, d)
    return r.select(*ORD_COLS, clean_price("price_pkr").alias("price_pkr"),
                    clean_price(F.col("price_original_pkr").cast("string")).alias("price_original_pkr"),
                    clean_price(F.format_number("l_extendedprice", 2)).alias("price_commas"))


@query
def clean_years(spark, d):
    r = B.raw(spark, d)
    return r.select(*ORD_COLS, clean_year("year_from").alias("year_from"),
                    clean_year("year_to").alias("year_to"),
                    clean_year(F.concat("year_to", F.lit(".0"))).alias("year_decimal"))


@query
def clean_listings(spark, d):
    return B.flat(_no_alts(B.cleaned(spark, d)))


@query
def drop_dead(spark, d):
    return B.flat(_no_alts(B.live(spark, d)))


@query
def zero_price_items(spark, d):
    return B.flat(_no_alts(C.zero_price_items(B.cleaned(spark, d))))


@query
def needs_enrichment_q(spark, d):
    c = B.cleaned(spark, d)
    return c.select(*[F.col("ord")[k].alias(k) for k in ORD_COLS],
                    needs_enrichment().alias("needs_enrichment"), needs_make().alias("needs_make"))


@query
def price_note(spark, d):
    c = C.price_note(B.live(spark, d))
    return c.select(*[F.col("ord")[k].alias(k) for k in ORD_COLS], "price_pkr", "available", "price_note")


# ---- de-duplication, alternatives, reports ------------------------------

@query
def dedupe_richest(spark, d):
    return B.flat(_no_alts(B.unique(spark, d)))


@query
def dedupe_priced(spark, d):
    return B.flat(_no_alts(DD.dedupe_priced(B.cleaned(spark, d))))


@query
def alternatives(spark, d):
    fin = B.flat(B.final(spark, d))
    out = explode_alternatives(fin, ORD_COLS)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query
def final_flatten(spark, d):
    return B.flat(B.final_flatten(B.final(spark, d)))


@query
def union_sources(spark, d):
    """Two sources concatenated by name: live listings and the zero-priced rows
    of the repair pass (which carry an extra note column)."""
    a = B.cleaned(spark, d).withColumn("source", F.lit("listing"))
    b = C.price_note(C.zero_price_items(B.cleaned(spark, d))).withColumn("source", F.lit("repair"))
    u = DD.union_sources(a.drop("alternatives"), b.drop("alternatives"))
    return B.flat(u).select(*ORD_COLS, "source", "part_name", "price_pkr", "price_note")


@query
def dataset_stats(spark, d):
    return ST.dataset_stats(B.final(spark, d))


@query
def scrape_summary(spark, d):
    return ST.scrape_summary(DD.dedupe_priced(B.cleaned(spark, d)))


@query
def top_categories(spark, d):
    return ST.top_categories(B.unique(spark, d))


@query
def top_makes(spark, d):
    return ST.top_makes(B.unique(spark, d))


@query
def by_source(spark, d):
    return ST.by_source(B.unique(spark, d))


@query
def stage_counts(spark, d):
    return ST.stage_counts(B.raw(spark, d))


@query
def enrichment_coverage(spark, d):
    return ST.enrichment_coverage(B.unique(spark, d))


@query
def known_values(spark, d):
    return ST.known_values(B.unique(spark, d))




# ---- scalar functions over the whole listing table -----------------------

def _texts(spark, d):
    return B.raw(spark, d, text=True)


@query
def parse_price(spark, d):
    from pricewright.functions import parse_price as pp
    r = _texts(spark, d)
    return r.select(*ORD_COLS, "price_text", pp("price_text").alias("price"),
                    pp("price_text", compat=True).alias("price_compat"))


@query
def parse_price_range(spark, d):
    from pricewright.functions import parse_price_range as ppr
    r = _texts(spark, d).withColumn("_r", ppr("price_text"))
    return r.select(*ORD_COLS, F.col("_r.low").alias("low"), F.col("_r.high").alias("high"))


@query
def price_text_rule(spark, d):
    from pricewright.functions import price_text_rule as ptr
    r = (_texts(spark, d).withColumn("_d", ptr("price_text", "del_text", "ins_text"))
         .withColumn("_c", ptr("price_text", "del_text", "ins_text", compat=True)))
    return r.select(*ORD_COLS, F.col("_d.price").alias("price"), F.col("_d.original").alias("original"),
                    F.col("_c.price").alias("price_compat"), F.col("_c.original").alias("original_compat"))


@query
def currency_search(spark, d):
    from pricewright.functions import currency_search as cs
    r = _texts(spark, d)
    return r.select(*ORD_COLS, cs(F.concat_ws(" ", "description", "price_text")).alias("price"))


@query
def absolute_url(spark, d):
    from pricewright.functions import absolute_url as au
    r = B.raw(spark, d)
    href = F.when(F.col("l_linenumber") % 2 == 0,
                  F.concat(F.lit(" /shop/"), F.col("l_partkey").cast("string"), F.lit("/ "))) \
            .otherwise(F.col("product_url"))
    return r.select(*ORD_COLS, au(href, F.lit("https://shop.example")).alias("product_url"))


@query
def log_target(spark, d):
    from pricewright.functions import inverse_target, log_target as lt
    u = B.flat(B.unique(spark, d))
    return u.select(*ORD_COLS, F.round(lt("price_pkr"), 6).alias("y"),
                    F.round(inverse_target(lt("price_pkr") - F.lit(1.0)), 4).alias("back"))


@query
def tokens(spark, d):
    from pricewright.functions import name_tokens
    from pricewright.sources.listings import read_table
    t = read_table(spark, d, "documents").select("doc_id", name_tokens("text").alias("tok"))
    return t.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"), F.array_join("tok", " ").alias("tokens"))


@query
def strip_fence(spark, d):
    from pricewright.functions import strip_fence as sf
    from pricewright.sources.listings import read_table
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))) \
              .when(F.col("turn") % 3 == 1, F.concat(F.lit("  ```"), "text", F.lit("``` "))) \
              .otherwise(F.col("text"))
    return conv.select("conv_id", "turn", sf(fenced).alias("text"))


@query
def offer_price(spark, d):
    from pricewright.functions.jsonval import with_offer_price
    r = B.raw(spark, d, text=True)
    p = F.col("l_extendedprice").cast("string")
    hi = round2(F.col("l_extendedprice") * 1.1).cast("string")
    style = F.col("l_linenumber") % 4
    js = (F.when(style == 0, F.concat(F.lit('{"offers": {"price": "'), p, F.lit('", "highPrice": "'), hi, F.lit('"}}')))
          .when(style == 1, F.concat(F.lit('{"offers": [{"lowPrice": '), p, F.lit('}]}')))
          .when(style == 2, F.concat(F.lit('{"Offers": {"price": "'), p, F.lit('"}}')))
          .otherwise(F.lit('{"offers": {"price": "call us"}}')))
    o = with_offer_price(r.select(*ORD_COLS, js.alias("js")), "js", "_o")
    return o.select(*ORD_COLS, F.col("_o.price").alias("price"), F.col("_o.original").alias("original"))


@query
def price_band(spark, d):
    from pricewright.functions import price_band as pb
    u = B.flat(B.unique(spark, d))
    return u.select(*ORD_COLS, pb(F.col("price_pkr") * 0.9, F.lit(1222.0)).alias("b")).select(*ORD_COLS, "b.*")


# ---- crawl bookkeeping -----------------------------------------------------

def _category_table(spark, d):
    """Category dimension derived from the data: one slug per part colour word,
    display name in title case."""
    from pricewright.sources.listings import read_table
    part = read_table(spark, d, "part")
    slug = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return part.select(slug.alias("slug")).distinct().withColumn("name", F.initcap("slug"))


@query
def category_filter(spark, d):
    return C.category_filter(_category_table(spark, d), ["al", "ro", "blu"])


@query
def category_names(spark, d):
    from pricewright.operators.crawl import category_names as cn
    r = B.cleaned(spark, d).withColumn("category_slug", F.col("scraped_category"))
    cats = C.category_filter(_category_table(spark, d), ["a", "e"])
    return B.flat(cn(r.drop("alternatives"), cats)).select(*ORD_COLS, "category_slug", "scraped_category")


@query
def resume_pending(spark, d):
    from pricewright.operators.crawl import resume_pending as rp
    cats = _category_table(spark, d)
    done = C.category_filter(cats, ["o"]).select("slug")
    return rp(cats, done)


@query
def page_prefix(spark, d):
    from pricewright.operators.crawl import page_prefix as pp
    from pricewright.sources.pages import crawl_pages
    return pp(crawl_pages(spark, d), max_pages=None).select("page_id", "category_slug", "page_no", "status", "n_cards")


@query
def page_url(spark, d):
    from pricewright.functions import page_url as pu
    from pricewright.sources.pages import crawl_pages
    p = crawl_pages(spark, d)
    return p.select("page_id", pu(F.lit("https://shop.example"), "category_slug", "page_no").alias("page_url"))


# ---- price repair ------------------------------------------------------------

def detail_table(spark, d):
    """What each product page says, derived from ``part``: four shop URLs per
    part (one per supplier slot), some gone, some unpriced, some out of stock."""
    from pricewright.sources.listings import read_table
    part = read_table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    x = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    h = F.col("p_partkey") + F.col("k")
    return x.select(
        F.concat(F.lit("https://shop.example/shop/"), F.col("p_partkey").cast("string"), F.lit("-"),
                 F.col("k").cast("string")).alias("product_url"),
        F.when(h % 7 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(h % 3 != 0, F.col("p_retailprice")).otherwise(F.lit(0.0)).alias("price"),
        F.when(F.col("p_size") > 25, round2(F.col("p_retailprice") * 1.1)).otherwise(F.lit(0.0)).alias("original_price"),
        (F.col("p_size") % 5 != 0).alias("available"),
        F.when(F.col("k") == 0, F.concat(F.lit("Detail "), F.col("p_name"))).otherwise(F.lit("")).alias("description"))


@query
def repair_prices(spark, d):
    from pricewright.operators.repair import repair_prices as rp
    rep = rp(B.cleaned(spark, d).drop("alternatives"), detail_table(spark, d))
    return B.flat(rep).select(*ORD_COLS, "price_pkr", "price_original_pkr", "available", "description", "_status")


@query
def repair_counters(spark, d):
    from pricewright.operators.repair import repair_counters as rc, repair_prices as rp
    return rc(rp(B.cleaned(spark, d).drop("alternatives"), detail_table(spark, d)))


@query
def repair_preview(spark, d):
    from pricewright.operators.repair import repair_preview as rp
    c = B.cleaned(spark, d)
    return rp(B.flat(c.drop("alternatives")), ORD_COLS)


@query
def repair_pass(spark, d):
    """The composed pass over all listings: its rebuilt catalogue, with the pass's counters on each row."""
    from pricewright.operators.repair import repair_pass as rp
    out = rp(B.cleaned(spark, d).drop("alternatives"), detail_table(spark, d))
    final = B.flat(B.final_flatten(out.final)).select(*ORD_COLS, "part_name", "price_pkr", "price_original_pkr",
                                                      "available", "description", "alternatives_count")
    return final.select("*", *[F.lit(out.counts[k]).cast("long").alias(k) for k in (
        "visited", "fixed", "marked_out_of_stock", "gone", "still_zero", "dropped", "kept")])


REGISTRY["needs_enrichment"] = REGISTRY.pop("needs_enrichment_q")


# ---- features ------------------------------------------------------------------

def _train_view(spark, d):
    from pricewright.operators.features import training_view
    return training_view(B.flat(B.final_flatten(B.final(spark, d))))


def _split_key():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ORD_COLS])


def _prepared(spark, d):
    from pricewright.operators.features import prepare
    return prepare(_train_view(spark, d))


@query
def trim_outliers(spark, d):
    from pricewright.operators.features import positive_price, trim_outliers as to
    return to(positive_price(_train_view(spark, d))).select(*ORD_COLS, "price_pkr")


@query
def fill_missing(spark, d):
    from pricewright.operators.features import fill_missing as fm, positive_price
    out = fm(positive_price(_train_view(spark, d)))
    return out.select(*ORD_COLS, "part_brand", "scraped_category", "compatible_make", "compatible_model",
                      "condition", "part_type", "year_from", "year_to", "price_original_pkr", "alternatives_count")


@query
def engineered_features(spark, d):
    return _prepared(spark, d).select(*ORD_COLS, "year_span", "has_year", "is_universal", "has_discount",
                                      "name_word_count")


@query
def frequency_maps(spark, d):
    from pricewright.operators.features import frequency_maps as fm
    return fm(_prepared(spark, d))


@query
def price_mean_maps(spark, d):
    from pricewright.operators.features import price_mean_maps as pm
    return pm(_prepared(spark, d))


@query
def lookup_encode(spark, d):
    from pricewright.operators.features import FREQ_COLS, MEAN_COLS, encode, fit_maps
    p = _prepared(spark, d)
    return encode(p, fit_maps(p), codes=False).select(
        *ORD_COLS, *[f"{c}_freq" for c in FREQ_COLS], *[f"{c}_price_mean" for c in MEAN_COLS])


@query
def group_mean_transform(spark, d):
    from pricewright.operators.features import group_mean_transform as gm
    return gm(_prepared(spark, d), "scraped_category", out="category_mean").select(*ORD_COLS, "category_mean")


@query
def ordinal_encode(spark, d):
    from pricewright.operators.features import ORDINAL_COLS, encode, fit_maps
    p = _prepared(spark, d)
    return encode(p, fit_maps(p), frequencies=False, means=False).select(*ORD_COLS, *[f"{c}_code" for c in ORDINAL_COLS])


@query
def split_assign(spark, d):
    from pricewright.operators.features import split_assign as sa
    return sa(_prepared(spark, d), _split_key()).select(*ORD_COLS, "split")


@query
def features(spark, d):
    from pricewright.operators.features import ENG_FEATURES, NUM_FEATURES, ORDINAL_COLS, features as fe
    enc, _ = fe(_train_view(spark, d), key=_split_key(), fit_on="train")
    return enc.select(*ORD_COLS, "split", "price_pkr", *[f"{c}_code" for c in ORDINAL_COLS],
                      *NUM_FEATURES, *ENG_FEATURES)


@query
def serving_features(spark, d):
    """Test rows encoded with maps fitted on training rows only: values never
    seen in training fall back to the defaults (-1 / 0 / global mean)."""
    from pricewright.operators.features import ENG_FEATURES, ORDINAL_COLS, encode, fit_maps
    p = _split_frame(spark, d)
    t = encode(p.filter(F.col("split") == "test"), fit_maps(p.filter(F.col("split") == "train")))
    return t.select(*ORD_COLS, *[f"{c}_code" for c in ORDINAL_COLS], *ENG_FEATURES[5:])


@query
def price_stats(spark, d):
    return ST.price_stats(_prepared(spark, d))


# ---- evaluation on deterministic baseline predictors -------------------------

def _split_frame(spark, d):
    from pricewright.operators.features import split_assign as sa
    return sa(_prepared(spark, d), _split_key())


def _baseline(frame, col):
    """Group-mean price of ``col`` fitted on training rows; unseen -> train mean."""
    train = frame.filter(F.col("split") == "train")
    means = train.groupBy(col).agg(F.avg("price_pkr").alias("_m"))
    glob = train.agg(F.avg("price_pkr")).scalar()
    return (frame.join(means, col, "left")
            .withColumn("predicted", F.coalesce(F.col("_m"), glob)).drop("_m")
            .withColumn("actual", F.col("price_pkr")))


def _test_preds(spark, d, col="scraped_category"):
    return _baseline(_split_frame(spark, d), col).filter(F.col("split") == "test")


@query
def regression_metrics(spark, d):
    from pricewright.plans.evaluate import regression_metrics as rm
    return rm(_test_preds(spark, d))


@query
def bucket_metrics(spark, d):
    from pricewright.plans.evaluate import bucket_metrics as bm
    return bm(_test_preds(spark, d))


@query
def error_by_category(spark, d):
    from pricewright.plans.evaluate import error_by
    return error_by(_baseline(_split_frame(spark, d), "scraped_category"), "scraped_category", 15)


@query
def error_by_make(spark, d):
    from pricewright.plans.evaluate import error_by
    return error_by(_baseline(_split_frame(spark, d), "scraped_category"), "compatible_make", 10)


@query
def sample_predictions(spark, d):
    from pricewright.plans.evaluate import sample_predictions as sp
    return sp(_test_preds(spark, d), ORD_COLS)


@query
def select_best(spark, d):
    """Three baseline predictors scored on the same test rows; best by R2."""
    from pricewright.plans.evaluate import regression_metrics as rm, select_best as sb
    frame = _split_frame(spark, d)
    rows = []
    for rank, col in enumerate(["scraped_category", "compatible_make", "part_brand"]):
        m = rm(_baseline(frame, col).filter(F.col("split") == "test"), median_ae=False)
        rows.append(m.select(F.lit(f"mean_by_{col}").alias("model"), F.lit(rank).alias("rank"), "r2"))
    metrics = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return sb(metrics)


# ---- text features -------------------------------------------------------------

def _docs(spark, d):
    from pricewright.operators.tfidf import with_terms
    return with_terms(_split_frame(spark, d).select(*ORD_COLS, "split", "part_name"))


@query
def tfidf_vocab(spark, d):
    """The vocabulary the models use: of the training rows only."""
    from pricewright.operators.tfidf import vocabulary
    from pricewright.plans.train import train_rows
    return vocabulary(train_rows(_docs(spark, d)))


@query
def tfidf_weights(spark, d):
    from pricewright.operators.tfidf import vocabulary, weights
    from pricewright.plans.train import train_rows
    docs = _docs(spark, d)
    return weights(docs, vocabulary(train_rows(docs)), ORD_COLS)


@query
def tfidf_documents(spark, d):
    """The same vocabulary step over the documents table (long texts)."""
    from pricewright.operators.tfidf import vocabulary, with_terms
    from pricewright.sources.listings import read_table
    return vocabulary(with_terms(read_table(spark, d, "documents").select("text"), "text"))


# ---- enrichment ----------------------------------------------------------------

def _batched(spark, d):
    from pricewright.operators.enrich import assign_batches
    from pricewright.session import materialize
    todo = materialize(B.flat(B.unique(spark, d).drop("alternatives")).filter(needs_enrichment()))   # read twice
    return assign_batches(todo.withColumn("ord", F.struct(*ORD_COLS)), _split_key())


def synth_responses(batched):
    """A stand-in model derived from the rows: per row one of four element
    shapes (full object, missing keys, explicit nulls, a bare number); per
    batch a fenced reply, a bare object instead of an array, or one extra
    element."""
    v = F.col("l_partkey") % 4
    word = F.split_part(F.col("part_name"), F.lit(" "), F.lit(2))
    elem = (F.when(v == 0, F.format_string(
                '{"part_brand": "B-%d", "part_type": "%s", "compatible_make": "Make %d", '
                '"compatible_model": "Model %d", "year_from": %d, "year_to": "%d", "condition": "Used"}',
                F.col("l_suppkey") % 10, word, F.col("l_partkey") % 7, F.col("l_suppkey") % 3,
                F.col("l_linenumber") + 2000, F.col("l_linenumber") + 2010))
            .when(v == 1, F.lit('{"part_type": "Filter"}'))
            .when(v == 2, F.lit('{"part_brand": null, "compatible_make": null, "year_from": 2017.9, "condition": ""}'))
            .otherwise(F.lit("5")))
    g = batched.groupBy("batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", elem.alias("e")))),
                                 lambda x: x["e"]), ",").alias("_body"))
    b = F.col("batch_id")
    arr = F.when(b % 6 == 1, F.concat(F.lit("["), "_body", F.lit(',{"part_type": "extra"}]'))) \
           .otherwise(F.concat(F.lit("["), "_body", F.lit("]")))
    resp = (F.when(b % 7 == 3, F.lit('{"part_type": "bare"}'))
             .when(b % 5 == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
             .otherwise(arr))
    return g.select("batch_id", resp.alias("response"))


@query
def enrichment_batches(spark, d):
    return _batched(spark, d).select(*ORD_COLS, "batch_id", "pos")


@query
def enrichment_prompts(spark, d):
    from pricewright.operators.enrich import build_prompts
    return build_prompts(_batched(spark, d))


@query
def parse_responses(spark, d):
    from pricewright.operators.enrich import _as_str, _field, parse_responses as pr
    from pricewright.session import materialize
    b = materialize(_batched(spark, d))
    p = pr(synth_responses(b))
    return p.select("batch_id", "pos", *[_as_str(_field(F.col("elem"), k)).alias(k)
                                         for k in ["part_brand", "compatible_make", "year_from"]])


@query
def merge_responses(spark, d):
    from pricewright.operators.enrich import merge_responses as mr, parse_responses as pr
    from pricewright.session import materialize
    b = materialize(_batched(spark, d))
    m = mr(b, pr(synth_responses(b)))
    return m.select(*ORD_COLS, "part_brand", "part_type", "compatible_make", "compatible_model",
                    "year_from", "year_to", "condition", "enriched")


# ---- model training and scoring (rows-only checks) --------------------------

def _ml_frame(spark, d):
    from pricewright.operators.features import features as fe
    enc, maps = fe(_train_view(spark, d), key=_split_key(), fit_on="train")
    return enc, maps


def _fit_preds(spark, d, preset):
    """The preset fitted at its whole size; the test rows with their predictions."""
    from pricewright.plans.train import WHOLE, fit, predict
    frame, _ = _ml_frame(spark, d)
    model = fit(frame, preset, sizes=WHOLE)
    return predict(model, frame.filter(F.col("split") == "test")).select(*ORD_COLS, "actual", "predicted")


@query
def fit_forest(spark, d):
    return _fit_preds(spark, d, "forest")


@query
def fit_gbt(spark, d):
    return _fit_preds(spark, d, "hist")


@query
def feature_count(spark, d):
    """Length of the feature vector as the fitted stages make it, and its parts."""
    from pricewright.plans.train import BASE_INPUTS, feature_pipeline
    frame, _ = _ml_frame(spark, d)
    vectors = feature_pipeline(frame).transform(frame)
    n = F.lit(vectors.schema["features"].metadata["ml_attr"]["num_attrs"]).cast("long")
    base = F.lit(len(BASE_INPUTS)).cast("long")
    return frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", base.alias("n_base"), (n - base).alias("n_text"), n.alias("n_features"))


@query
def feature_importance(spark, d):
    from pricewright.plans.train import feature_importance as fi, feature_names, fit
    frame, _ = _ml_frame(spark, d)
    model = fit(frame, "forest")
    return fi(model, feature_names(model), spark)


@query
def holdout_report(spark, d):
    """Fit the presets, keep the best by R2, report its holdout metrics per bucket."""
    from pricewright.plans.evaluate import bucket_metrics, select_best
    from pricewright.plans.train import predict, train_models
    frame, _ = _ml_frame(spark, d)
    models, metrics = train_models(frame, presets=("forest", "hist"))
    best = select_best(metrics).first()["best"]  # one row
    preds = predict(models[best], frame.filter(F.col("split") == "test"))
    return bucket_metrics(preds).withColumn("model", F.lit(best))


def _requests(spark, d):
    """Scoring requests derived from cleaned listings; rows on line 7 carry
    an impossible year and are rejected."""
    c = B.flat(B.cleaned(spark, d).drop("alternatives"))
    return c.select(*ORD_COLS, "part_name", "part_type", "part_brand", "scraped_category", "compatible_make",
                    "compatible_model", F.when(F.col("l_linenumber") == 7, F.lit(2099))
                    .otherwise(F.col("year_from")).alias("year_from"), "year_to", "price_original_pkr",
                    F.lit(None).cast("int").alias("alternatives_count"), "condition")


@query
def validate_requests(spark, d):
    from pricewright.plans.score import validate_requests as vr
    v = vr(_requests(spark, d))
    return v.select(*ORD_COLS, "valid", F.array_join("violations", ",").alias("violations"))


@query
def request_defaults(spark, d):
    from pricewright.plans.score import request_defaults as rd
    return rd(_requests(spark, d)).select(*ORD_COLS, "part_type", "part_brand", "scraped_category",
                                          "compatible_make", "compatible_model", "condition", "year_from",
                                          "year_to", "alternatives_count")


def _saved_model(spark, d, presets):
    """Train, compare and save (pipeline, maps, metadata) in the shared folder; the folder."""
    import uuid

    from pricewright.plans.evaluate import select_best
    from pricewright.plans.train import save_model, train_models
    from pricewright.session import ensure_checkpoint_dir
    frame, maps = _ml_frame(spark, d)
    models, metrics = train_models(frame, presets=presets)
    best = select_best(metrics).first()["best"]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    save_model(models[best], maps, metrics, best, path, frame, ST.price_stats(frame))
    return path


@query
def score_requests(spark, d):
    """Requests scored by a model read back from its folder, with a band of its own median error."""
    from pricewright.plans.score import score_saved
    from pricewright.session import materialize
    # the rules, the defaults and the encodings name each field many times: it is cleaned once
    scored, _ = score_saved(materialize(_requests(spark, d)), _saved_model(spark, d, ["hist"]))
    return scored.select(*ORD_COLS, "predicted_price_pkr", "confidence_range_low", "confidence_range_high",
                         "currency", "model_name")


@query
def model_info(spark, d):
    """Train, save under the shared checkpoint folder, load back and summarise."""
    from pricewright.plans.train import load_model, model_info as mi
    _, _, meta = load_model(spark, _saved_model(spark, d, ["hist"]))
    return mi(meta)


# ---- HTML extraction -------------------------------------------------------------

def card_pages(spark, d):
    """Listing pages rendered from the listing table: one page per order,
    one product card per line (sale rows carry del/ins, closed lines an
    out-of-stock badge)."""
    r = B.raw(spark, d, text=True)
    name = F.split_part(F.trim(F.col("part_name")), F.lit("  "), F.lit(1))
    card = F.concat(
        F.lit('<li class="product type-product"><a href="/shop/'), F.col("l_partkey").cast("string"), F.lit("-"),
        (F.col("l_suppkey") % 4).cast("string"), F.lit('"><h2 class="woocommerce-loop-product__title">'), name,
        F.lit('</h2></a><span class="price">'), F.col("price_text"), F.lit("</span>"),
        F.when(F.col("del_text").isNotNull(), F.concat(F.lit("<del>"), F.col("del_text"), F.lit("</del><ins>"),
                                                       F.col("ins_text"), F.lit("</ins>"))).otherwise(F.lit("")),
        F.when(~F.col("available"), F.lit('<span class="out-of-stock">Sold</span>')).otherwise(F.lit("")),
        F.lit("</li>"))
    pages = r.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", card.alias("c"))))
                                        .alias("_c"))
    html = F.concat(F.lit('<html><body><ul class="products">'),
                    F.array_join(F.transform("_c", lambda x: x["c"]), ""), F.lit("</ul></body></html>"))
    return pages.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


@query
def listing_cards(spark, d):
    from pricewright.operators.extract import listing_cards as lc
    return lc(card_pages(spark, d), base_url="https://shop.example").select(
        "page_id", "card_no", "part_name", "product_url", "price_pkr", "price_original_pkr", "available")


@query
def raw_listings(spark, d):
    """Cards of pages in configured and other categories, as the collection's raw rows."""
    from pricewright.operators.extract import listing_cards as lc, raw_listings as rl
    from pricewright.schemas import DEFAULT_CATEGORIES, categories_df
    slugs = F.array(*[F.lit(s) for s, _ in DEFAULT_CATEGORIES])
    k = (F.col("page_id") % (len(DEFAULT_CATEGORIES) + 2)).cast("int")
    pages = card_pages(spark, d).withColumn("category_slug", F.coalesce(F.get(slugs, k), F.lit("other/parts")))
    out = rl(lc(pages, base_url="https://shop.example"), categories_df(spark), "shop.example", "https://shop.example")
    return out.select("page_id", "card_no", "part_name", "scraped_category", "category_slug", "price_pkr",
                      "price_original_pkr", "available", "product_url", "website", "source_base", "part_brand",
                      "part_type", "compatible_make", "compatible_model", "year_from", "year_to", "condition",
                      "description")


def detail_pages(spark, d):
    """Product pages rendered from the listing table, one price layout per
    line number: sale pair, single amount, JSON-LD offer, meta tag, currency
    text in the summary, or none (out of stock)."""
    r = B.raw(spark, d)
    p = F.format_number("l_extendedprice", 2)
    hi = F.format_number(round2(F.col("l_extendedprice") * 1.2), 2)
    amt = lambda x: F.concat(F.lit('<span class="woocommerce-Price-amount amount">Rs '), x, F.lit("</span>"))
    k = F.col("l_linenumber") % 6
    body = (F.when(k == 0, F.concat(F.lit('<div class="summary"><p class="price"><del>'), amt(hi),
                                    F.lit("</del> <ins>"), amt(p), F.lit("</ins></p></div>")))
            .when(k == 1, F.concat(F.lit('<div class="summary"><p class="price">'), amt(p), F.lit("</p></div>")))
            .when(k == 2, F.concat(F.lit('<script type="application/ld+json">{"offers": {"price": "'),
                                   F.col("l_extendedprice").cast("string"), F.lit('"}}</script>')))
            .when(k == 3, F.concat(F.lit('<meta property="product:price:amount" content="'),
                                   F.col("l_extendedprice").cast("string"), F.lit('">')))
            .when(k == 4, F.concat(F.lit('<div class="product-info">Now only Rs '), p, F.lit(" today</div>")))
            .otherwise(F.lit('<div class="summary"><p class="stock out-of-stock">Out of stock</p></div>')))
    desc = F.concat(F.lit('<div class="woocommerce-product-details__short-description"><p>'),
                    F.col("part_name"), F.lit("</p></div>"))
    sku = F.when(F.col("l_linenumber") < 7, F.concat(
        F.lit('<p>SKU: <span class="sku"> K-'), F.col("l_partkey").cast("string"), F.lit(" </span></p>"))).otherwise("")
    return r.select(F.xxhash64(*ORD_COLS).alias("page_id"), *ORD_COLS,
                    F.concat(F.lit("<html><body>"), body, desc, sku, F.lit("</body></html>")).alias("html"))


@query
def detail_prices(spark, d):
    from pricewright.operators.extract import detail_prices as dp
    return dp(detail_pages(spark, d)).select(*ORD_COLS, "price", "original_price", "available", "description")


@query
def detail_prices_inline(spark, d):
    from pricewright.operators.extract import detail_prices as dp
    return dp(detail_pages(spark, d), mode="inline").select(
        *ORD_COLS, "price", "original_price", "available", "description")


@query
def detail_skus(spark, d):
    from pricewright.operators.extract import detail_prices as dp
    return dp(detail_pages(spark, d)).select(*ORD_COLS, "sku")


@query
def page_detail_robustness(spark, d):
    """Every crawled page runs through the detail extractor without error."""
    from pricewright.operators.extract import detail_prices as dp
    from pricewright.sources.pages import crawl_pages
    return dp(crawl_pages(spark, d).select("page_id", "html")).select("page_id", "price", "original_price")
