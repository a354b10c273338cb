"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, the
character n-grams (of UTF-8 bytes, the blank around a word included), and pairs
of neighbouring words (a word that repeats the one before it is one feature of
its own). A softmax layer on the
mean gives the class. Vectors and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``per_class`` of each
class, chosen by hash). As everything after training is linear, scoring needs
one number per bucket, and the whole text of every document is scored in one
pass of array operations.

Labels, language, source and id are never inputs. Defined results: null and
empty texts have no features and score the base rate of the training rows.
Without rows of both classes every document gets the only class seen (1 if
none). Duplicate rows are scored each; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import small_batches, table
from pricewright.llm.toxicity import in_fold

BUCKETS = 1 << 18
DIM = 16
GRAMS = (3, 5)          # in bytes
PER_CLASS = 2000
EPOCHS = 5
RATE = 0.5
PART = 1 << 18          # bytes whose features are hashed at a time


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


BYTE = _byte_codes()
POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list, bucket) of every feature of some texts."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = BYTE[np.where(blank, 32, data)]
    where, bucket = [], []

    def add(at, b):
        where.append(np.searchsorted(ends, at, "right"))
        bucket.append(b)

    solid = ~blank
    for n in GRAMS:
        inner = solid[1:len(data) - n + 2].copy()      # the first and last byte may be the blank around a word
        for i in range(2, n - 1):
            inner &= solid[i:len(data) - n + 1 + i]
        at = np.flatnonzero(inner[:max(0, len(data) - n + 1)])
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[at + i]
        add(at, _bucket(h, n))
    first = np.flatnonzero(solid[1:] & blank[:-1]) + 1
    if len(first):
        last = np.flatnonzero(solid[:-1] & blank[1:]) + 1
        body = np.flatnonzero(solid)
        word = np.repeat(first, last - first)
        begins = np.cumsum(last - first) - (last - first)
        h = np.add.reduceat(code[body] * POWER[(body - word) % 64], begins)
        add(first, _bucket(h, 1))
        doc = np.searchsorted(ends, first, "right")
        same = doc[1:] == doc[:-1]
        a, b = h[:-1][same], h[1:][same]
        add(first[1:][same], np.where(a == b, 1, _bucket(a * np.uint64(31) + b, 7)))
    return np.concatenate(where), np.concatenate(bucket)


def chunks(texts: list[str | None]):
    """Parts of texts, about PART bytes at a time: (their places in the list, the
    parts). A longer text is cut at a blank, or where PART ends without one."""
    ids, parts, size = [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = len(raw) if len(raw) - at <= PART else (raw.rfind(b" ", at + 1, at + PART) if
                                                          raw.find(b" ", at + 1, at + PART) >= 0 else at + PART)
            ids.append(i)
            parts.append(raw[at:end])
            size += end - at + 1
            at = end
            if size >= PART:
                yield ids, parts
                ids, parts, size = [], [], 0
            if at >= len(raw):
                break
    if ids:
        yield ids, parts


def _features(batches):
    """Distinct buckets of a text and how often each occurs."""
    for b in batches:
        texts = b["text"].to_pylist()
        ids, counts = [], []
        for t in texts:
            got = [features(parts)[1] for _, parts in chunks([t])]
            u, n = np.unique(np.concatenate(got), return_counts=True)
            ids.append(u.astype("<u4").tobytes())
            counts.append(n.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), b["y"]], names=["ids", "counts", "y"])


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> tuple[np.ndarray, float]:
    """Per-bucket weight (the class 1 logit less the class 0 logit) and bias.
    rows: (bucket ids, counts, label)."""
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), 8.0 if not len(y) or y[0] == 1 else -8.0
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    data = [(np.frombuffer(i, "<u4"), (c := np.frombuffer(n, "<u4").astype(np.float32)) / max(1.0, c.sum()), k)
            for i, n, k in rows]
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            ids, share, k = data[j]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ emb[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            if len(ids):
                # the mean's gradient goes in full to every vector of the text, by its share
                emb[ids] -= (lr * len(ids)) * share[:, None] * back
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _scorer(weights: np.ndarray, bias: float, offset: float):
    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            total, n = np.zeros(len(texts)), np.zeros(len(texts))
            for ids, parts in chunks(texts):
                where, bucket = features(parts)
                ids = np.array(ids)[where]
                total += np.bincount(ids, weights[bucket], len(texts))
                n += np.bincount(ids, minlength=len(texts))
            z = np.where(n > 0, total / np.maximum(n, 1) + bias, 0.0) + offset
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
            per_class: int = PER_CLASS) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``. ``held_out`` is a
    condition on the id; rows that meet it teach nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
             .filter("_id IS NOT NULL AND y IS NOT NULL")
             .groupBy("_id").agg(F.when(F.max("y") == 1, 1).otherwise(0).alias("y")))
    if held_out is not None:
        known = known.filter(~held_out(F.col("_id")))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.filter("y = 0").orderBy(F.xxhash64("_id")).limit(per_class).unionByName(
        known.filter("y = 1").orderBy(F.xxhash64("_id")).limit(per_class))
    # at most 2 * per_class ids by the limits above
    rows = [(r.ids, r.counts, r.y) for r in
            texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "y")
            .mapInArrow(_features, "ids binary, counts binary, y int").toLocalIterator()]
    rows.sort()
    weights, bias = train(rows)
    offset = 0.0
    if sizes.get(0) and sizes.get(1):     # classes were sampled alike; go back to their shares
        took = [min(sizes[k], per_class) for k in (0, 1)]
        offset = float(np.log(sizes[1] / sizes[0]) - np.log(took[1] / took[0]))
    kind = dict(texts.dtypes)["doc_id"]
    return (texts.mapInArrow(_scorer(weights, bias, offset), f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: in_fold(i, 3, 1))
    return out.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
