"""Similarity join on word n-grams by universe partition and pigeonhole.

A document is the set of its distinct word n-grams, hashed to 64 bits. Two sets
with Jaccard similarity t or more differ in at most H n-grams, H following from
the sizes. Sizes fall into bands. For a band the universe of n-grams is hashed
into m segments; a set emits, for its own band and the lower bands it can still
match, one key per segment: a hash of what it has there.

Allocation, per band, whichever costs less in keys and expected chance matches:
 * whole segments: m = H + 1 + c. At least 1 + c segments of a similar pair are
   equal, so every set may leave out its c most frequent keys. Empty segments
   count as the most frequent, then come keys by frequency. As the order is the
   same for all, the least frequent common key is never left out by either side.
 * one-deletion neighbourhoods: m = ceil((H + 1) / 2). Some segment differs in
   one n-gram at most, so the key of the segment of one set is the key of the
   other's segment or of that less one n-gram. Chosen for small sets.

Candidates share a key. Parity bitmaps give a lower bound of the difference and
drop most of them; the rest is verified exactly on the whole texts.

Only connections are needed, so a key's documents are first compared with its
least document (a star); documents of a key that then lie in different
components are compared inside tasks, which send on the most promising pairs,
in rounds until none is left untried. Copies (equal sets) are one node throughout.

Defined results: null, empty and blank texts have no n-grams and link with
nothing; with fewer words than n, the whole sequence is one n-gram. A null id
links with nothing. Rows that share an id are one node. An empty table gives an
empty result."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm._common import batches_of, join_hot, small_batches, stage, table
from pricewright.llm.graph import components

BAND = 1.3              # ratio of the sizes of a band
SLACK = 0.2             # share of segments that may be left out
CHANCE = 5e4            # documents of a band times the cost of a chance match, in keys
PARITY_WORDS = 16       # 64 bits each
SEEN = 200_000          # sets remembered by a task, to emit the keys of copies once
BLOCK = 1500            # documents of a key that a task compares with as many others
PER_ROUND = 64          # pairs a document tries per key, foreign component and round
HUB_ROWS = 500          # pairs that share a copy of one text in verification
BROADCAST_IDS = 1_000_000   # candidate ids are broadcast up to this number (8 MB)


# ---- n-grams

def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(31) + h[i:len(h) - k + 1 + i], 0x5851F42D4C957F2D)
    return np.unique(out)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the n-grams that hash to k."""
    bits = np.bincount((mix(s, 0x2545F491) % np.uint64(64 * PARITY_WORDS)).astype(np.int64),
                       minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(">u8").astype(np.int64)


# ---- bands and their allocation; percent is the threshold in hundredths

def most_different(total: int, percent: int) -> int:
    """Largest difference of two sets with ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def _chance(size: int, m: int, c: int) -> float:
    """Cost of the chance matches of a set of this size. Unrelated sets share the
    keys of segments that are empty in both; a set leaves out its first c empty
    ones, so what counts is how many it has beyond them (Poisson)."""
    mean = m * math.exp(-size / m)
    p, beyond = math.exp(-mean), mean - c
    for k in range(c):
        beyond += (c - k) * p
        p *= mean / (k + 1)
    return CHANCE * max(0.0, beyond) ** 2 / m


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple:
    """(low, high, H, m, c, deletions) of the bands up to a size."""
    out, low = [], 1
    while low <= upto:
        high = max(low, int(low * BAND))
        h = most_different(high + high * 100 // percent, percent)
        if h == 0:
            high = low
            h = most_different(high + high * 100 // percent, percent)
        c = math.ceil(SLACK * (h + 1))
        whole, halves = h + 1 + c, -(-(h + 1) // 2)
        deletions = high + halves + _chance(low, halves, 0) < whole + _chance(low, whole, c)
        out.append((low, high, h, halves if deletions else whole, 0 if deletions else c, deletions))
        low = high + 1
    return tuple(out)


def _bands_for(size: int, percent: int) -> list[tuple]:
    """The bands of all sets not larger than this one that can match it; equal sets are found otherwise."""
    top = 1 << max(10, (2 * size).bit_length())
    low = -(-size * percent // 100)
    return [(i, *b) for i, b in enumerate(bands(percent, top)) if b[1] >= low and b[0] <= size and b[2] > 0]


def keys_of(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and how many of its frequent keys in the same band it may leave out."""
    keys, slack = [], []
    for band, _, _, _, m, c, deletions in _bands_for(len(s), percent):
        seg = (mix(s, 0x9E37 + band) % np.uint64(m)).astype(np.int64)
        part = mix(s, 0x51ED)
        total = np.zeros(m, np.uint64)
        np.add.at(total, seg, part)
        place = np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 1_000_003)
        if deletions:
            k = np.unique(np.concatenate([mix(total, 0xD) + place, mix(total[seg] - part, 0xD) + place[seg]]))
            left = 0
        else:
            used = np.zeros(m, bool)
            used[seg] = True
            empty = np.flatnonzero(~used)
            take = np.concatenate([np.flatnonzero(used), empty[c:]])     # empty ones are left out first
            k = mix(total[take], 0xE) + place[take]
            left = max(0, c - len(empty))
        keys.append(k)
        slack.append(np.full(len(k), left, np.int32) * 1000 + band)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(slack)


def _describe(n: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t, n) for t in b["text"].to_pylist()]
            bits = [parity(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "digest", "bits"])
    return run


def _emit(n: int, percent: int):
    def run(batches):
        seen: set = set()
        for b in batches:
            ids, keys, slack = [], [], []

            def flush():
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64), pa.int64()),
                     pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(slack), pa.int32())],
                    names=["key", "id", "slack"])
                ids.clear(), keys.clear(), slack.clear()
                return out

            held = 0
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                s = shingles(t, n)
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                k, c = keys_of(s, percent)
                if len(k):
                    keys.append(k)
                    ids.append(np.full(len(k), i, np.int64))
                    slack.append(c)
                    held += len(k)
                if held > 200_000:
                    yield flush()
                    held = 0
            if held:
                yield flush()
    return run


# ---- verification

def _verify(n: int, percent: int):
    def run(batches):
        last, mine = None, None
        for b in batches:
            ok = []
            for a, x, y in zip(b["a"].to_pylist(), b["ta"].to_pylist(), b["tb"].to_pylist()):
                if a != last:
                    last, mine = a, shingles(x, n)
                other = shingles(y, n)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are similar. Pairs that
    share a are dealt out in parts of HUB_ROWS, each with its own copy of a's text."""
    spark = pairs.sparkSession
    pairs = stage(pairs, "pairs")
    if not pairs.take(1):
        return pairs
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    few = ids.count() <= BROADCAST_IDS
    mine = stage(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"]), "pair-texts")
    size = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("parts", F.ceil(F.col("n") / HUB_ROWS).cast("int")), "pair-hubs")
    dealt = join_hot(pairs, size, "a", "n").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = (size.join(mine, size.a == mine.id).select(
        "a", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    right = dealt.join(mine, dealt.b == mine.id).select("a", "part", "b", F.col("text").alias("tb"))
    with batches_of(spark, 200):
        return stage(right.join(left, ["a", "part"]).select("a", "b", "ta", "tb")
                     .mapInArrow(_verify(n, percent), "a long, b long"), "links")


def _nearest(percent: int):
    """Pairs of one pair of blocks of a key that may be similar and lie in
    different components: for each document and foreign component the PER_ROUND
    with the least difference by parity, of those not tried before."""
    def run(t: pa.Table, tried: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], pa.int64()) for k in ("key", "lo", "hi", "a", "b")})
        if t.num_rows < 2:
            return empty
        t = t.sort_by("id")
        ids, comp, block, size = (t[c].to_numpy() for c in ("id", "comp", "block", "n"))
        bits = np.array(t["bits"].to_pylist(), np.int64).view(np.uint64)
        before: dict[int, set] = {}
        for x, y in zip(tried["a"].to_pylist(), tried["b"].to_pylist()):
            before.setdefault(x, set()).add(y)
        across = block.min() != block.max()
        out = []
        for i in range(len(ids) - 1):
            rest = slice(i + 1, len(ids))
            total = size[i] + size[rest]
            ok = (comp[rest] != comp[i]) & (np.minimum(size[i], size[rest]) * 100
                                            >= np.maximum(size[i], size[rest]) * percent)
            if across:
                ok &= block[rest] != block[i]
            near = np.flatnonzero(ok)
            differ = np.bitwise_count(bits[i] ^ bits[rest][near]).sum(1, dtype=np.int64)
            fits = differ * (100 + percent) <= total[near] * (100 - percent)
            near, differ = near[fits] + i + 1, differ[fits]
            taken: dict[int, int] = {}
            done = before.get(int(ids[i]), ())
            for j in near[np.argsort(differ, kind="stable")].tolist():
                c, y = int(comp[j]), int(ids[j])
                if y not in done and taken.get(c, 0) < PER_ROUND:
                    taken[c] = taken.get(c, 0) + 1
                    out.append((int(ids[i]), y))
        if not out:
            return empty
        pairs = list(zip(*out))
        same = {k: pa.array([t[k][0].as_py()] * len(out), pa.int64()) for k in ("key", "lo", "hi")}
        return pa.table({**same, "a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})
    return run


def _link_mixed(groups: DataFrame, links: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, component) by ``links`` and what is missing for the components of all documents that
    share a key. A key's documents are dealt into blocks of about BLOCK, and each
    task compares two blocks, so no task holds a whole large key. A round tries
    the most promising pairs of different components; rounds go on until no
    untried pair is left, so nothing is dropped."""
    spark = groups.sparkSession
    tried = None
    w = Window.partitionBy("key")
    while True:
        joined = components(links)
        found = joined.withColumnRenamed("component", "comp")
        placed = groups.join(found, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        mixed = stage(placed.withColumn("least", F.min("comp").over(w)).withColumn("most", F.max("comp").over(w))
                      .filter("least <> most").select("key", "id", "comp"), "ngram-mixed")
        if not mixed.take(1):
            return joined
        # of keys with the same documents one will do
        same = (mixed.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("x"),
                                         F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"), F.count(F.lit(1)).alias("size"))
                .groupBy("x", "y", "size").agg(F.min("key").alias("key")))
        chosen = stage(same.select("key", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed-keys")
        dealt = (join_hot(mixed, chosen, "key", "size")
                 .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("key", "id", "comp", "block", F.least("block", "other").cast("long").alias("lo"),
                         F.greatest("block", "other").cast("long").alias("hi")).join(nodes, "id"))
        schema = "key long, lo long, hi long, a long, b long"
        known = tried if tried is not None else spark.createDataFrame([], schema)
        new = stage(dealt.groupBy("key", "lo", "hi").cogroup(known.groupBy("key", "lo", "hi"))
                    .applyInArrow(_nearest(percent), schema), "ngram-tried")
        if not new.take(1):
            return joined
        pairs = new.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti")
        # what is linked already is one link a document to its component
        links = (joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
                 .unionByName(verified(pairs, texts, n, percent)))
        tried = new if tried is None else stage(tried.unionByName(new), "ngram-tried")


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and parity bitmaps allow the similarity."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"),
                                  F.col("bits").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                         lambda t, x: t + x)
    total = F.col("na") + F.col("nb")
    return both.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
                       & (differ * (100 + percent) <= total * (100 - percent))).select("a", "b")


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, copy_of) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(_describe(n), "id long, n long, digest binary, bits array<long>"), "ngram-sets")
    live = rows.filter("id IS NOT NULL AND n > 0")
    copies = stage(live.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"),
                                              F.first("n").alias("n"), F.first("bits").alias("bits")), "ngram-nodes")
    nodes = copies.select(F.col("node").alias("id"), "n", "bits")
    copy_of = stage(join_hot(live.select("id", "digest"), copies.select("digest", "node", "size"), "digest", "size")
                    .select("id", "node").distinct(), "ngram-copies")

    keys = texts.filter("id IS NOT NULL").mapInArrow(_emit(n, percent), "key long, id long, slack int")
    shared = stage(keys.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key")))
                   .filter("times > 1"), "ngram-keys")
    per_set = Window.partitionBy("id", "slack").orderBy(F.desc("times"), "key")
    kept = (shared.withColumn("place", F.row_number().over(per_set))
            .filter(F.col("place") > F.floor(F.col("slack") / 1000)).select("key", "id"))
    # copies from different tasks become one node
    kept = kept.join(copy_of, "id").select("key", F.col("node").alias("id")).distinct()
    groups = stage(kept.withColumn("hub", F.min("id").over(Window.partitionBy("key")))
                   .withColumn("most", F.max("id").over(Window.partitionBy("key")))
                   .filter("hub <> most").select("key", "id", "hub"), "ngram-groups")
    star = stage(groups.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(),
                 "ngram-star")
    first = verified(_bounded(star, nodes, percent), texts, n, percent)
    joined = _link_mixed(groups.select("key", "id"), first, nodes, texts, n, percent)
    named = (copy_of.join(joined, copy_of.node == joined.id, "left")
             .select(copy_of.id.alias("_id"), F.coalesce("component", "node").alias("component"), "node"))
    named = named.groupBy("_id").agg(F.min("component").alias("component"), F.min("node").alias("node"))
    return (rows.select("id", "n").join(named, rows.id == F.col("_id"), "left")
            .select(F.col("id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id"), F.coalesce("node", "id").alias("copy_of")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)
