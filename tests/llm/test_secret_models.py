"""The likelihood ratio of the secret scan on names that are no secrets and strings that are, and very many matches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pricewright.llm import secret_scan as S

ORDINARY = ["IMG_20230412_153000", "backup_20240115_v2", "20230412T153000Z", "model_checkpoint_000125",
            "550e8400-e29b-41d4-a716-446655440000", "getCustomerAddress", "internationalization", "report-final-2024-03-09",
            "MAX_CONNECTION_TIMEOUT", "src/components/header_000012"]
RANDOM = ["kQzXvWpLrTmNbHgFdSaJyUo", "x7Kp2mQ9vR4tZ8wL3nB6", "Zq3/7Hd+9kLm2Xv5Tn8Rw1", "PLqWmZxKvJtRbYhGcNsD"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")


def test_names_are_left_alone_and_random_strings_found(spark, corpus):
    rows = [(-i - 1, f"see {w} here") for i, w in enumerate(ORDINARY + RANDOM)]
    out = S.scan_secrets(corpus.union(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {r.doc_id: r.n_markov for r in out.filter("doc_id < 0").collect()}
    assert {ORDINARY[i]: got[-i - 1] for i in range(len(ORDINARY))} == dict.fromkeys(ORDINARY, 0)
    found = sum(got[-i - 1 - len(ORDINARY)] for i in range(len(RANDOM)))
    assert found >= 3 and got[-1 - len(ORDINARY)] == 1
    assert out.filter("doc_id >= 0 AND n_markov > 0").count() <= 10       # of 10,000 texts


def test_very_many_matches(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    S.scan_secrets(df.filter("doc_id = 2"), model=[0.0] * (len(S.ALPHABET) + 1) ** 2).collect()
    t = time.time()
    r = S.scan_secrets(df, model=[0.0] * (len(S.ALPHABET) + 1) ** 2, threshold=1.0).filter("doc_id = 1").first()
    took = time.time() - t
    assert r.n_hex == 16_000 and [tuple(s) for s in r.all_spans[:2]] == [(0, 32, 2), (33, 65, 2)]
    assert r.spans.endswith(f"hex:{33 * 15_999}:{33 * 15_999 + 32}") and took < 20


def test_empty_and_overlapping(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert not S.scan_secrets(empty).collect() and not S.redact_secrets(empty).collect()
    spans = spark.createDataFrame([("abcdefghij", [(1, 4, 0), (2, 6, 1), (8, 10, 2)]), ("x", [])],
                                  "t string, s array<struct<start:int,end:int,kind:int>>")
    got = [r[0] for r in spans.select(S.redact(F.col("t"), F.col("s"), "#")).collect()]
    assert got == ["a#gh#", "x"]
