"""Exact duplicate removal with a two-pass Bloom filter.

Pass one builds a filter of the text hashes that may occur more than once.
Pass two tests every row: rows that fail the test are unique and go straight
to the result; only the others are shuffled, grouped by their SHA-256.

Defined results: a null text counts as empty. Of equal texts the row with the
smallest id stays, null ids last; of rows that also share the id exactly one
stays. Columns of the input that bear an output's name are replaced. An empty
table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import bloom
from pricewright.llm._common import join_hot, stage, table, without

SPACE = "[\\x20\\x09-\\x0D]+"
MAX_FILTER_BITS = 1 << 29   # 64 MB broadcast at most


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def dedup_by_digest(df: DataFrame, digest: str = "text_sha256", id_col: str = "doc_id",
                    max_filter_bits: int = MAX_FILTER_BITS, bits_per_key: int = 16) -> DataFrame:
    """Add keep_id, group_size and kept; equal digests are equal texts."""
    spark = df.sparkSession
    df = without(df, "keep_id", "group_size", "kept").withColumn("_pw_h", F.xxhash64(digest))
    bits = bloom.size_for(df.count(), bits_per_key, max_filter_bits)
    seen = bloom.repeated_filter(
        df, lambda b: [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)], bits, "_pw_h")

    @F.pandas_udf("boolean")
    def again(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.maybe_repeated(seen.value, h.to_numpy(np.int64).view(np.uint64)))

    tested = df.withColumn("_pw_again", again("_pw_h")).drop("_pw_h")
    unique = (tested.filter(~F.col("_pw_again")).drop("_pw_again")
              .withColumn("keep_id", F.col(id_col)).withColumn("group_size", F.lit(1).cast("long"))
              .withColumn("kept", F.lit(True)))
    maybe = stage(tested.filter("_pw_again").drop("_pw_again")
                  .withColumn("_pw_row", F.monotonically_increasing_id()), "dedup-rows")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_pw_row")))
    groups = stage(maybe.groupBy(digest).agg(first.alias("m"), F.count(F.lit(1)).alias("group_size"))
                   .select(digest, F.col(f"m.{id_col}").alias("keep_id"), F.col("m._pw_row").alias("_pw_keep"),
                           "group_size"), "dedup-groups")
    joined = (join_hot(maybe, groups, digest, "group_size")
              .withColumn("kept", F.col("_pw_row") == F.col("_pw_keep")).drop("_pw_row", "_pw_keep"))
    return unique.unionByName(joined.select(*unique.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with text_sha256, keep_id, group_size, kept."""
    return dedup_by_digest(without(docs, "text_sha256").withColumn("text_sha256", text_digest(F.col(text_col))),
                           "text_sha256", id_col)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_digest(F.col("text")).alias("text_sha256"))
    return dedup_by_digest(stage(docs, "digests")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
