"""Interchangeable-part links without a self-join.

The rule: parts with the same (type, make, model) - lower-trimmed, type and
make non-blank, make not "universal" - list up to 10 group members with a
different product URL, in first-seen order.

Plan (linear in rows, bounded per group):
1. per (group, url class) keep the first 11 members, where the class is the
   URL itself for blank URLs and one shared class for all non-blank URLs.
   A single ``row_number() <= 11`` filter lets Spark insert a partial
   WindowGroupLimit before the shuffle, so a hot group ships at most 11 rows
   per input partition.
2. collect those few candidates per group (bounded by 11 x classes).
3. join the candidates back to each member on the group key and drop the
   member's own URL, keep the first 10 by position. Rows without a group are
   spread over keys that match nothing, so they never meet in one task.
Non-blank URLs are unique after de-duplication, so the first 11 non-blank
candidates always leave 10 after removing the row itself; a blank-URL row
skips every member with its exact URL, which the per-class candidates cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pricewright.functions import ws_trim
from pricewright.schemas import ALTERNATIVE, MAX_ALTERNATIVES

GROUP = "_group"


def _norm(c):
    return F.lower(ws_trim(F.coalesce(F.col(c), F.lit(""))))


def with_group_key(df: DataFrame) -> DataFrame:
    """``_group``: type, make and model of a row that takes part, else null."""
    kind, make, model = (_norm(c) for c in ("part_type", "compatible_make", "compatible_model"))
    eligible = (kind != "") & (make != "") & (make != "universal")
    return df.withColumn(GROUP, F.when(eligible, F.concat_ws("\x01", kind, make, model)))


def eligible():
    return F.col(GROUP).isNotNull()


def candidates(members: DataFrame, order_col: str = "ord", cap: int = MAX_ALTERNATIVES) -> DataFrame:
    """One row per group: array of at most (cap+1) x url-classes candidates, in first-seen order."""
    url_class = F.when(ws_trim(F.col("product_url")) == "", F.col("product_url")).otherwise(F.lit(None))
    w = Window.partitionBy(GROUP, "_url_class").orderBy(order_col)
    firsts = (members.filter(eligible())
              .select(GROUP, order_col, "part_name", "part_brand", "price_pkr", "product_url",
                      url_class.alias("_url_class"))
              .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap + 1))
    cand = F.struct(F.col(order_col).alias("o"), F.col("product_url").alias("u"),
                    F.struct("part_name", "part_brand", "price_pkr", "product_url").alias("alt"))
    return firsts.groupBy(GROUP).agg(F.sort_array(F.collect_list(cand)).alias("_cand"))


def build_alternatives(df: DataFrame, order_col: str = "ord", cap: int = MAX_ALTERNATIVES) -> DataFrame:
    """Fill ``alternatives`` for every row; ineligible rows get []. The input is read twice, the
    first time only the columns of a candidate; nothing runs before the result is asked for."""
    keyed = with_group_key(df.drop("alternatives") if "alternatives" in df.columns else df)
    found = candidates(keyed, order_col, cap).withColumnRenamed(GROUP, "_found")
    alone = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(order_col), F.lit(65536)).cast("string"))
    joined = keyed.withColumn(GROUP, F.coalesce(GROUP, alone)).join(found, F.col(GROUP) == F.col("_found"), "left")
    mine = F.col("product_url")
    picked = F.slice(F.filter("_cand", lambda c: c["u"] != mine), 1, cap)
    alts = F.coalesce(F.transform(picked, lambda c: c["alt"]).cast(ArrayType(ALTERNATIVE)),
                      F.array().cast(ArrayType(ALTERNATIVE)))
    return joined.withColumn("alternatives", alts).drop("_cand", "_found", GROUP)


def explode_alternatives(df: DataFrame, id_cols) -> DataFrame:
    """One row per (part, alternative) with a 1-based position."""
    return df.select(*id_cols, F.posexplode("alternatives").alias("pos", "alt")) \
             .select(*id_cols, (F.col("pos") + 1).alias("pos"), "alt.*")
