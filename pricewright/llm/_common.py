"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder. Unlike an RDD
    checkpoint it is compressed, pruned on reading and has a known size, so the
    planner can choose joins by size."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts takes in a Python worker."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if int(now) <= 0 or int(now) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of this many rows for what is staged inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add under the same names."""
    have = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in have])


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, share: int = 256) -> DataFrame:
    """Inner join on one key where some keys hold a large part of ``left``.

    ``right`` has one row per key and the number of left rows of that key in
    ``size``; it should be staged. Keys with at least 1/share of all left rows
    (so never more than ``share`` keys) are broadcast and their left rows stay
    where they are; only the rest is shuffled."""
    total = right.agg(F.sum(size)).first()[0] or 0
    limit = max(1000, -(-total // share))
    heavy = right.filter(F.col(size) >= limit)
    if not heavy.take(1):
        return left.join(right, key)
    hot = left.join(F.broadcast(heavy), key)
    cold = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right.filter(F.col(size) < limit), key)
    return hot.unionByName(cold)
