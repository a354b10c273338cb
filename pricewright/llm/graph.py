"""Connected components of a link table, by alternating large and small stars.

Links are first reduced inside their tasks. What is left is dealt over one task
per PER_TASK links; links that fit one task are done then, without any round."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm._common import join_hot, stage

PER_TASK = 200_000      # links of one task, two numbers each


def _forest(batches):
    """The links of one task, reduced to one per node: node and least node it reaches here."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [n for n in parent if find(n) != n]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i:i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([find(n) for n in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, max_rounds: int = 60, per_task: int | None = None) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the least id reached."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    now = stage(links.mapInArrow(_forest, "a long, b long"), "links")
    if now.count() <= (PER_TASK if per_task is None else per_task):
        return _named(stage(now.coalesce(1).mapInArrow(_forest, "a long, b long"), "links"))
    now = stage(now.distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
                      .select("u", F.least("u", "m").alias("m"), "n"), "links-least")
        large = (join_hot(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = stage(large, "links-large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "links-least")
        small = join_hot(large, least, "a", "n")
        now = stage(small.select("a", F.col("m").alias("b"))
                    .union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(),
                    "links")
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
