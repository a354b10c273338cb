"""Price-model features as DataFrame operations.

Every fitted lookup (frequencies, target means, ordinal codes) is a row of one
table, computed by one grouped aggregate and joined back once per column;
nothing is collected to the driver except the <=300-term vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import finite_positive, word_count
from pricewright.operators.clean import normalise_missing
from pricewright.operators.lookup import lookup_join
from pricewright.operators.ranks import dealt, offsets, quantiles, with_rank
from pricewright.session import materialize

TARGET = "price_pkr"
# Feature groups of the price model, in matrix order.
CAT_FEATURES = ["part_brand", "scraped_category", "compatible_make", "compatible_model", "condition"]
HIGH_CARD_CAT = "part_type"
NUM_FEATURES = ["year_from", "year_to", "price_original_pkr", "alternatives_count"]
TEXT_FEATURE = "part_name"
ENG_FEATURES = ["year_span", "has_year", "is_universal", "has_discount", "name_word_count",
                "compatible_make_freq", "compatible_model_freq", "part_brand_freq", "scraped_category_freq",
                "scraped_category_price_mean", "compatible_make_price_mean"]
FREQ_COLS = ["compatible_make", "compatible_model", "part_brand", "scraped_category"]
MEAN_COLS = ["scraped_category", "compatible_make"]
DROP_COLS = ["available", "website", "product_url", "description"]
ORDINAL_COLS = CAT_FEATURES + [HIGH_CARD_CAT]


def training_view(final_flat: DataFrame) -> DataFrame:
    """The CSV hand-off without a file: missing tokens -> null, feature
    columns only (plus whatever id columns the caller kept)."""
    return normalise_missing(final_flat).drop(*DROP_COLS)


def positive_price(df: DataFrame) -> DataFrame:
    return df.filter(finite_positive(TARGET))


def quantile_bounds(df: DataFrame, lo: float = 0.01, hi: float = 0.99, col: str = TARGET,
                    exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """One row (q_lo, q_hi): exact linear-interpolated quantiles by distributed
    selection, or approx_percentile."""
    if exact:
        q = quantiles(df, col, [lo, hi])
    else:
        q = df.agg(F.approx_percentile(F.col(col), F.array(F.lit(lo), F.lit(hi)), accuracy).alias("q"))
    return q.select(F.col("q")[0].alias("q_lo"), F.col("q")[1].alias("q_hi"))


def trim_outliers(df: DataFrame, lo: float = 0.01, hi: float = 0.99, exact: bool = True) -> DataFrame:
    """Keep rows with price inside [q_lo, q_hi], bounds from a scalar subquery."""
    q = quantile_bounds(df, lo, hi, exact=exact).select(F.array("q_lo", "q_hi")).scalar()
    return df.filter(F.col(TARGET).between(q[0], q[1]))


def fill_missing(df: DataFrame, make_default: str = "Unknown", model_default: str = "Unknown") -> DataFrame:
    fills = {c: "Unknown" for c in ORDINAL_COLS}
    fills["compatible_make"], fills["compatible_model"] = make_default, model_default
    out = df
    for c in ["year_from", "year_to", "alternatives_count"]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("int"))
    out = out.withColumn("price_original_pkr", F.coalesce(F.col("price_original_pkr"), F.lit(0.0)))
    for c, v in fills.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out.withColumn(TEXT_FEATURE, F.coalesce(F.col(TEXT_FEATURE), F.lit("")))


def engineered(df: DataFrame) -> DataFrame:
    return (df.withColumn("year_span", F.greatest(F.col("year_to") - F.col("year_from"), F.lit(0)))
              .withColumn("has_year", ((F.col("year_from") > 0) | (F.col("year_to") > 0)).cast("int"))
              .withColumn("is_universal", (F.lower("compatible_make") == "universal").cast("int"))
              .withColumn("has_discount", (F.col("price_original_pkr") > 0).cast("int"))
              .withColumn("name_word_count", word_count(TEXT_FEATURE)))


def _long(df: DataFrame, cols) -> DataFrame:
    """(column, value) pairs: one explode of a literal-keyed array (unpivot)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*")


def frequency_maps(df: DataFrame, cols=FREQ_COLS) -> DataFrame:
    """(column, value, freq): share of rows holding the value."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (_long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .select("column", "value", (F.col("n") / total).alias("freq")))


def price_mean_maps(df: DataFrame, cols=MEAN_COLS) -> DataFrame:
    """(column, value, mean_price) plus one ('*', null, global mean) row."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(TARGET).alias("y"))
        for c in cols])).alias("kv")).select("kv.*")
    per = long.groupBy("column", "value").agg(F.avg("y").alias("mean_price"))
    glob = df.agg(F.avg(TARGET).alias("mean_price")).select(
        F.lit("*").alias("column"), F.lit(None).cast("string").alias("value"), "mean_price")
    return per.unionByName(glob)


def fit_maps(rows: DataFrame) -> DataFrame:
    """Every lookup of the feature step in one table, from one pass over ``rows``:
    (column, value, n, freq, mean_price, code), plus a ('*', null) row of all rows.

    ``code`` is the 0-based rank of the value among the sorted distinct values of
    its column (binary string order); null values have none."""
    long = rows.select(F.col(TARGET).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in ORDINAL_COLS])).alias("kv"))
    per = (long.groupBy("kv.column", "kv.value")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_price"), F.sum("y").alias("sum")))
    table = dealt(per, ["column"], "value")
    known = F.col("value").isNotNull().cast("long")
    one = table.filter(F.col("column") == ORDINAL_COLS[0])          # each column has every row once
    total = one.agg(F.sum("n")).scalar()
    whole = one.agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("mean_price")).select(
        F.lit("*").alias("column"), F.lit(None).cast("string").alias("value"), "n", F.lit(1.0).alias("freq"),
        "mean_price", F.lit(None).cast("double").alias("code"))
    ranked = with_rank(table, offsets(table, known), "value", known)
    return materialize(ranked.select(
        "column", "value", "n", (F.col("n") / total).alias("freq"), "mean_price",
        F.when(F.col("value").isNotNull(), F.col("rank")).cast("double").alias("code")).unionByName(whole))


def encode(df: DataFrame, maps: DataFrame, frequencies: bool = True, means: bool = True,
           codes: bool = True) -> DataFrame:
    """Frequencies (missing -> 0), log1p target means (missing -> the global mean) and ordinal codes
    (missing -> -1) of the categorical columns: one join per column, whatever it has to bring."""
    mean_of_all = maps.filter(F.col("column") == "*").select("mean_price").scalar()
    out = df
    for c in ORDINAL_COLS:
        new = {f"{c}_freq": ("freq", F.lit(0.0))} if frequencies and c in FREQ_COLS else {}
        if means and c in MEAN_COLS:
            new[f"{c}_price_mean"] = "mean_price", mean_of_all
        if codes:
            new[f"{c}_code"] = "code", F.lit(-1.0)
        if not new:
            continue
        mine = maps.filter(F.col("column") == c).select("value", "n", *[F.col(v).alias(k) for k, (v, _) in new.items()])
        out = lookup_join(out, mine, c, "value", "n")
        out = out.withColumns({k: F.coalesce(k, default) for k, (_, default) in new.items()})
    return out.withColumns({f"{c}_price_mean": F.log1p(f"{c}_price_mean") for c in MEAN_COLS}) if means else out


def group_mean_transform(df: DataFrame, col: str, target: str = TARGET, out: str | None = None) -> DataFrame:
    """Group mean attached to each row. A grouped aggregate joined back
    (partial aggregation absorbs hot groups), not a window."""
    means = df.groupBy(col).agg(F.avg(target).alias("_gm"))
    return df.join(means, col, "left").withColumnRenamed("_gm", out or f"{col}_{target}_mean")


def split_assign(df: DataFrame, key, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Deterministic hash split stored as a column: 'test' when the first 32
    bits of md5(seed:key) / 2^32 fall below ``test_size``."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(2 ** 32)
    return df.withColumn("split", F.when(h < test_size, F.lit("test")).otherwise(F.lit("train")))


def prepare(df: DataFrame, trim: bool = True, make_default: str = "Unknown",
            model_default: str = "Unknown") -> DataFrame:
    """Positive price, outlier trim, fills and engineered columns.

    The priced rows are checkpointed first: the quantile bounds and the
    trim both read them, and this is the hand-off point between the
    catalogue build and modelling."""
    base = materialize(positive_price(df))
    if trim:
        base = trim_outliers(base)
    return engineered(fill_missing(base, make_default, model_default))


def features(df: DataFrame, key=None, fit_on: str = "train", maps: DataFrame | None = None,
             trim: bool = True, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training frame: prepare -> split column -> maps -> encodings.

    ``fit_on='train'`` fits the lookup maps on training rows only (no
    target leakage); ``'all'`` reproduces fitting on every row."""
    base = prepare(df, trim)
    if key is not None:
        base = split_assign(base, key, test_size, seed)
    if maps is None:
        fit = base.filter(F.col("split") == "train") if (fit_on == "train" and key is not None) else base
        maps = fit_maps(fit)
    return encode(base, maps), maps
