"""Exact ranks and quantiles without a global sort in one task.

Distinct values (with their counts) are dealt by range over the partitions, so
the order of the partitions is the order of the values. A sum per partition
gives every partition its offset, and a running sum inside each partition gives
the rank of every value. The table of offsets has one row per partition and
group; nothing else is gathered in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.session import materialize

GROUP, PART = "_rk_group", "_rk_part"


def dealt(values: DataFrame, by: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """The rows dealt by range of (by, value), with their group and partition, as a checkpointed table."""
    parts = parts or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return materialize(values.withColumn(GROUP, group).repartitionByRange(parts, GROUP, value)
                       .withColumn(PART, F.spark_partition_id()))


def offsets(table: DataFrame, weight: Column) -> DataFrame:
    """(group, partition, before, inside, total): weight of a group before and inside each partition."""
    inside = table.groupBy(GROUP, PART).agg(F.sum(weight).alias("inside"))
    order = Window.partitionBy(GROUP).orderBy(PART)     # one row a partition
    before = F.coalesce(F.sum("inside").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("before", before).withColumn("total", F.sum("inside").over(Window.partitionBy(GROUP)))


def with_rank(table: DataFrame, places: DataFrame, value: str, weight: Column) -> DataFrame:
    """Adds ``rank``, the weight of all smaller values of the group, and ``total``. Partitions of the
    table that ``places`` does not name are left out."""
    here = Window.partitionBy(GROUP, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = table.join(places.select(GROUP, PART, "before", "total"), [GROUP, PART])
    return near.withColumn("rank", F.col("before") + F.coalesce(F.sum(weight).over(here), F.lit(0))).drop("before")


def quantiles(df: DataFrame, value: str | Column, qs: Sequence[float], by: Sequence[str] = (),
              parts: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (by..., q), q an array in the order of ``qs``.

    Nulls are left out. Without ``by`` there is always one row, of nulls for an empty input."""
    column = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*by, column.cast("double").alias("_v")).filter("_v IS NOT NULL")
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    table = dealt(counts, by, "_v", parts)
    at = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    ends = [(F.floor(at(q)).cast("long"), F.ceil(at(q)).cast("long"), at(q)) for q in qs]
    places = offsets(table, F.col("_n"))
    wanted = F.lit(False)
    for low, high, _ in ends:
        for rank in (low, high):
            wanted = wanted | ((F.col("before") <= rank) & (rank < F.col("before") + F.col("inside")))
    ranked = with_rank(table, places.filter(wanted), "_v", F.col("_n"))
    held = lambda r: F.max(F.when((F.col("rank") <= r) & (r < F.col("rank") + F.col("_n")), F.col("_v")))
    q = [held(low) + (held(high) - held(low)) * F.max(place - low) for low, high, place in ends]
    out = (ranked.groupBy(GROUP) if by else ranked).agg(F.array(*q).alias("q"))
    return out.select(*[F.col(f"{GROUP}.{c}").alias(c) for c in by], "q")


def median(df: DataFrame, value: str | Column) -> Column:
    """The exact median as a scalar subquery."""
    return quantiles(df, value, [0.5]).select(F.col("q")[0]).scalar()
