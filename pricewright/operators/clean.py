"""Row cleaning and row filters (one projection each, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import (clean_price, clean_str, clean_year, finite_positive,
                                   na_to_null, needs_enrichment, ws_trim)
from pricewright.schemas import ALTERNATIVE, DESCRIPTION_CHARS, NA_TOKENS, STRING_COLS
from pyspark.sql.types import ArrayType

# Fixed value: note for in-stock rows that still have no price.
PRICE_NOTE = "Variable pricing - contact seller"


def _opt(df: DataFrame, name: str, default=None):
    return F.col(name) if name in df.columns else F.lit(default)


def clean_expressions(df: DataFrame) -> list:
    """The fixed 16-column projection of a raw listing."""
    dtypes = dict(df.dtypes)
    cond = clean_str(F.coalesce(_opt(df, "condition"), F.lit("New")))
    return [
        *[clean_str(_opt(df, c)).alias(c) for c in STRING_COLS],
        clean_year(_opt(df, "year_from"), dtypes.get("year_from")).alias("year_from"),
        clean_year(_opt(df, "year_to"), dtypes.get("year_to")).alias("year_to"),
        *[clean_price(_opt(df, c), dtypes.get(c)).alias(c) for c in ("price_pkr", "price_original_pkr")],
        F.coalesce(F.nullif(cond, F.lit("")), F.lit("New")).alias("condition"),
        F.coalesce(_opt(df, "available").cast("boolean"), F.lit(True)).alias("available"),
        F.coalesce(_opt(df, "website").cast("string"), F.lit("")).alias("website"),
        F.coalesce(_opt(df, "product_url").cast("string"), F.lit("")).alias("product_url"),
        F.substring(clean_str(_opt(df, "description")), 1, DESCRIPTION_CHARS).alias("description"),
        F.array().cast(ArrayType(ALTERNATIVE)).alias("alternatives"),
    ]


def clean_listings(df: DataFrame, keep=("ord",)) -> DataFrame:
    """Drop rows without a name (tested before cleaning), then clean.

    Columns named in ``keep`` (for example the position column) pass through."""
    named = df.filter(F.col("part_name").isNotNull() & (F.col("part_name") != ""))
    extra = [F.col(c) for c in keep if c in df.columns]
    return named.select(*extra, *clean_expressions(named))


def drop_dead(df: DataFrame) -> DataFrame:
    """Keep rows that have a price or are in stock (NaN is not a price); the price, a text to be
    parsed, is asked for last."""
    return df.filter(F.col("available") | finite_positive("price_pkr"))


def zero_price_items(df: DataFrame) -> DataFrame:
    """Rows that need a price repair."""
    return df.filter(F.col("price_pkr").isNull() | (F.col("price_pkr") <= 0))


def price_note(df: DataFrame, note: str = PRICE_NOTE) -> DataFrame:
    """Tag rows still without a price but in stock."""
    still_zero = (F.col("price_pkr").isNull() | (F.col("price_pkr") <= 0)) & F.col("available")
    return df.withColumn("price_note", F.when(still_zero, F.lit(note)))


def normalise_missing(df: DataFrame, cols=None, tokens=NA_TOKENS) -> DataFrame:
    """Blank strings and CSV missing tokens -> null (what a CSV round trip does)."""
    cols = cols or [c for c, t in df.dtypes if t == "string"]
    return df.select(*[na_to_null(c, tokens).alias(c) if c in cols else F.col(c) for c in df.columns])


def category_filter(categories: DataFrame, terms, col: str = "slug") -> DataFrame:
    """Keep categories whose slug contains any requested term (empty terms keep all)."""
    if not terms:
        return categories
    arr = F.array(*[F.lit(t) for t in terms])
    return categories.filter(F.exists(arr, lambda t: F.col(col).contains(t)))
