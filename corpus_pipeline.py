"""From raw documents to packed training sequences.

Each stage reads what the one before kept, as Parquet in the shared folder, and
its decisions take effect: toxic documents go, of equal texts and of groups of
similar texts one document stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import stage, table
from pricewright.llm.exact_dedup import exact_dedup
from pricewright.llm.ngram_join import ngram_join
from pricewright.llm.packing import pack
from pricewright.llm.secret_scan import redact_secrets
from pricewright.llm.toxicity import fit_toxicity, in_fold, without_toxic

NGRAM_WORDS = 5
NGRAM_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: in_fold(i, 5, 0))
    return without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join(docs, n=NGRAM_WORDS, percent=NGRAM_PERCENT)
    gone = stage(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("secret scans", mask_secrets), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
