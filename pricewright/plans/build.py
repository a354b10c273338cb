"""The catalogue build: load -> clean -> drop dead -> dedupe -> (enrich) ->
alternatives. Two shuffles (dedupe key, group key), no driver collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pricewright.operators.alternatives import build_alternatives
from pricewright.operators.clean import clean_listings, drop_dead  # noqa: F401
from pricewright.operators.dedupe import dedupe_richest
from pricewright.session import materialize
from pricewright.sources.listings import listings


def flat(df: DataFrame) -> DataFrame:
    """Position struct -> its columns, for reports and oracle checks."""
    return df.select("ord.*", *[c for c in df.columns if c != "ord"])


def raw(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    return listings(spark, d, with_price_text=text)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean_listings(raw(spark, d))


def live(spark: SparkSession, d: str) -> DataFrame:
    return drop_dead(cleaned(spark, d))


def unique(spark: SparkSession, d: str) -> DataFrame:
    return dedupe_richest(live(spark, d))


def final(spark: SparkSession, d: str) -> DataFrame:
    return build_alternatives(materialize(unique(spark, d)))     # read twice


def build(df: DataFrame, enrich_fn=None, order_col: str = "ord", watch: StageCounts | None = None) -> DataFrame:
    """Whole build over any raw listing frame carrying a position column. ``watch`` observes
    the rows of every stage while the build runs, at no job of its own."""
    see = watch.see if watch else lambda name, rows: rows
    named = see("cleaned", clean_listings(see("raw", df), keep=(order_col,)))
    out = see("deduplicated", dedupe_richest(see("live", drop_dead(named)), order_col))
    if enrich_fn is not None:
        from pricewright.operators.enrich import enrich_unknowns
        out = enrich_unknowns(out, enrich_fn, order_col=order_col)
    return build_alternatives(out, order_col)


class StageCounts:
    """Row counts of a build's stages, known once the built table has been written."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def see(self, name: str, rows: DataFrame) -> DataFrame:
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    @property
    def counts(self) -> dict[str, int]:
        n = {name: int(o.get["n"]) for name, o in self.seen.items()}
        return n | {"dropped": n["cleaned"] - n["live"]}


def final_flatten(df: DataFrame) -> DataFrame:
    """CSV shape: alternatives replaced by their count."""
    return df.withColumn("alternatives_count", F.size("alternatives")).drop("alternatives")
