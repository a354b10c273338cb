"""Removal of byte strings that also occur earlier, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a row before (by id) or further left in the same row. All is judged on the
input.

Sorting the suffixes of a whole corpus would move each byte about a hundred
times, so equal strings are brought together first. Every window of ``length``
bytes has an anchor, the least hash of its ``GRAM``-byte strings, leftmost among
equals; equal windows have equal anchors at equal places. The windows of one
anchor occurrence are neighbours, and their bytes are a short context.

1. A two-pass Bloom filter of anchors drops those that occur once.
2. Per task, equal contexts are merged: only the first is sent on, the windows
   of the others are repeats. So a passage that a third of all rows share leaves
   a task once.
3. Contexts are dealt to shards by anchor. A shard builds the suffix array of
   its different contexts: order by 7 bytes, then Larsson-Sadakane refinement,
   which doubles the depth and sorts only groups still tied. Kasai's inequality
   gives the common prefixes; neighbours that share ``length`` bytes are equal
   windows, and all but the earliest are repeats.
4. An anchor with very many different contexts spreads over several suffix
   arrays; sorted windows of one are looked up in the others by binary search.
5. Runs of removed bytes per row are united and the texts cut.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing. Null ids come last. Rows that share an id are told apart by a row
number given when the table is staged. An empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import bloom
from pricewright.llm._common import small_batches, stage, table

LENGTH = 100
GRAM = 32
PIECE = 1 << 18            # bytes that are anchored at a time, two parts below 2 ** 20
SHARD_BYTES = 4 << 20      # text per shard aimed at
ARRAY_BYTES = 1 << 20      # bytes of contexts in one suffix array
HELD = 150_000             # contexts a task holds before it sends them on
MAX_FILTER_BITS = 1 << 29  # 64 MB broadcast at most
LAST = (1 << 63) - 1


# ---- anchors

def _byte_hashes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


BYTE = _byte_hashes()


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width`` elements, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` bytes (a power of two) from each place."""
    h, have, mult = BYTE[data], 1, np.uint64(0xD6E8FEB86659FD93)
    while have < gram:
        h = h[:-have] * mult + h[have:]
        mult = mult * mult
        have *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(first window, number of windows, anchor hash) of each anchor occurrence
    in texts that stand at [starts, ends) of data; windows stay inside a text."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = _slide((h & ~low) | place, length - GRAM + 1, np.minimum)
    at = (least & low).astype(np.int64)
    fits = np.zeros(len(at) + 1, np.int64)
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s >= length:
            fits[s] += 1
            fits[e - length + 1] -= 1
    ok = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    if not len(ok):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    a = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    return ok[first], np.diff(np.append(first, len(ok))), h[a[first]]


def pieces(texts, length: int = LENGTH):
    """Pack (key, bytes) into buffers of about PIECE bytes: (data, starts, ends,
    keys, offset of each part in its text). Long texts come in parts that
    overlap by length - 1, so that each window is in one part."""
    held: list = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(t for _, t, _ in held), np.uint8)
        sizes = np.array([len(t) for _, t, _ in held])
        ends = np.cumsum(sizes)
        return data, ends - sizes, ends, [k for k, _, _ in held], [o for _, _, o in held]

    for key, text in texts:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at:at + PIECE + length - 1]
            if len(part) < length:
                continue
            held.append((key, part, at))
            size += len(part)
            if size >= PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _texts(b: pa.RecordBatch):
    for i, r, t in zip(b["_id"].to_pylist(), b["_row"].to_pylist(), b["text"].to_pylist()):
        if t:
            yield (i, r), t.encode("utf-8", "surrogatepass")


def _anchor_hashes(length: int):
    def run(b):
        for data, starts, ends, _, _ in pieces(_texts(b), length):
            yield anchors(data, starts, ends, length)[2]
    return run


# ---- per task: contexts of repeated anchors, equal ones merged

OUT = "shard long, anchor long, id long, row long, at long, n long, context binary"


def _contexts(seen, shards: int, length: int):
    def run(batches):
        first: dict[bytes, tuple] = {}
        gone: list = []

        def repeat(key, at, n):
            if gone and gone[-1][0] == key and gone[-1][1] <= at <= gone[-1][2]:
                gone[-1][2] = max(gone[-1][2], at + n + length - 1)
            else:
                gone.append([key, at, at + n + length - 1])

        def flush():
            rows = [(a % shards, a if a < 1 << 63 else a - (1 << 64), k[0], k[1], at, n, c)
                    for c, (k, at, n, a) in first.items()]
            rows += [(hash((k[0], k[1])) % shards, None, k[0], k[1], lo, hi - lo, None) for k, lo, hi in gone]
            first.clear()
            gone.clear()
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i:i + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())],
                    names=[f.split(" ")[0] for f in OUT.split(", ")])

        for b in batches:
            for data, starts, ends, keys, offsets in pieces(_texts(b), length):
                at, n, h = anchors(data, starts, ends, length)
                hit = np.flatnonzero(bloom.maybe_repeated(seen.value, h)) if len(h) else []
                if not len(hit):
                    continue
                raw = data.tobytes()
                at, n, h = at[hit], n[hit], h[hit]
                text = np.searchsorted(starts, at, "right") - 1
                inside = at - starts[text]
                for s, m, a, k, i in zip(at.tolist(), n.tolist(), h.tolist(), text.tolist(), inside.tolist()):
                    c, key, i = raw[s:s + m + length - 1], keys[k], i + offsets[k]
                    old = first.get(c)
                    if old is None:
                        first[c] = (key, i, m, a)
                    elif (old[0], old[1]) <= (key, i):
                        repeat(key, i, m)
                    else:
                        repeat(old[0], old[1], m)
                        first[c] = (key, i, m, a)
            if len(first) > HELD or len(gone) > HELD:
                yield from flush()
        yield from flush()
    return run


# ---- per shard: suffix arrays

def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array. Larsson-Sadakane: the rank of a group of suffixes that
    agree so far is the place of its last member; only groups of two or more are
    sorted again, by the rank of the suffix ``have`` further on. The order is
    complete, which Kasai's inequality needs."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    # bytes are 1..256 here, so seven of them fit a key
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key * np.uint64(512) + padded[i:i + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, np.diff(np.append(np.flatnonzero(new), n)))
    have = 7
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))       # places in groups of two or more
    while len(tied):
        members = order[tied]
        after = members + have
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[members]
        again = np.lexsort((second, group))
        members, group, second = members[again], group[again], second[again]
        order[tied] = members
        edge = np.ones(len(tied), bool)
        edge[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(tied)) - 1
        rank_new = np.repeat(tied[stop], np.diff(np.append(begin, len(tied))))
        rank[members] = rank_new
        single = edge & np.append(edge[1:], True)
        tied = tied[~single]
        have *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Bytes each suffix shares with the one before it in the order, up to
    ``cap``. By Kasai's inequality a suffix shares at least one byte less than
    its left neighbour in the text, so every 16th is compared from the start
    and the others from what the inequality grants them."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int16), np.full(cap + 8, -1, np.int16)])
    shared = np.zeros(n, np.int64)

    def extend(at, floor):
        other = before[at]
        some = other >= 0
        at, other, have = at[some], other[some], floor[some]
        while len(at):
            i, j = at + have, other + have
            same = (i < n) & (j < n) & (have < cap)
            same &= padded[np.minimum(i, n + cap)] == padded[np.minimum(j, n + cap)]
            shared[at[~same]] = have[~same]
            at, other, have = at[same], other[same], have[same] + 1

    base = np.arange(0, n, 16)
    extend(base, np.zeros(len(base), np.int64))
    for d in range(1, 16):
        at = np.arange(d, n, 16)
        extend(at, np.maximum(0, shared[at - 1] - 1))
    return shared[order]


def repeats_in(contexts: list[tuple], length: int) -> list[tuple[int, np.ndarray]]:
    """contexts: (position key, windows, bytes), all different. For each, which of
    its windows equal a window at a smaller position: (place in the list, mask)."""
    data = np.frombuffer(b"\0".join(c for _, _, c in contexts), np.uint8)
    sizes = np.array([len(c) for _, _, c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.full(len(data), -1, np.int64)
    for k, (b, (_, m, _)) in enumerate(zip(begin.tolist(), contexts)):
        owner[b:b + m] = k
    order = suffix_order(data)
    shared = common_prefixes(data, order, length)
    # groups of equal windows: neighbours in order with enough in common
    group = np.cumsum(shared < length)
    use = owner[order] >= 0
    group, where = group[use], order[use]
    who = owner[where]
    # contexts are listed by position, so the least list place is the earliest window
    sort = np.lexsort((where, who, group))
    group, where, who = group[sort], where[sort], who[sort]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    masks: dict[int, np.ndarray] = {}
    for k, w in zip(who[later].tolist(), where[later].tolist()):
        masks.setdefault(k, np.zeros(contexts[k][1], bool))[w - begin[k]] = True
    return list(masks.items())


def _windows(contexts: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows in order (as byte strings closed by a 1), their context and offset."""
    rows, who, off = [], [], []
    for k, (_, m, c) in enumerate(contexts):
        raw = np.frombuffer(c, np.uint8)
        rows.append(np.lib.stride_tricks.sliding_window_view(raw, length)[:m])
        who.append(np.full(m, k))
        off.append(np.arange(m))
    rows, who, off = np.concatenate(rows), np.concatenate(who), np.concatenate(off)
    closed = np.hstack([rows, np.ones((len(rows), 1), np.uint8)])
    flat = np.ascontiguousarray(closed).view(f"S{length + 1}").ravel()
    order = np.lexsort((off, who, flat))
    return flat[order], who[order], off[order]


def _shard(length: int):
    def run(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        anchors_of: dict[int, dict] = {}
        for a, i, r, at, n, c in zip(*(t[x].to_pylist() for x in ("anchor", "id", "row", "at", "n", "context"))):
            if c is None:
                out.append((i, r, at, at + n))
                continue
            same = anchors_of.setdefault(a, {})
            old, key = same.get(c), (i, r, at)
            if old is None or key < old[0]:
                if old is not None:
                    out.append((*old[0], old[0][2] + old[1] + length - 1))
                same[c] = (key, n)
            else:
                out.append((*key, at + n + length - 1))
        work, held = [], 0

        def emit(contexts, masks):
            for k, mask in masks:
                i, r, at = contexts[k][0]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    out.append((i, r, at + lo, at + hi - 1 + length))

        def solve(contexts):
            contexts.sort(key=lambda x: x[0])
            emit(contexts, repeats_in(contexts, length))

        for same in anchors_of.values():
            if len(same) < 2:
                continue
            contexts = [(k, n, c) for c, (k, n) in same.items()]
            size = sum(len(c) for _, _, c in contexts)
            if size > ARRAY_BYTES:
                _split(contexts, length, emit)
                continue
            work += contexts
            held += size
            if held > ARRAY_BYTES:
                solve(work)
                work, held = [], 0
        if work:
            solve(work)
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("id", "row", "lo", "hi"), cols)})
    return run


def _split(contexts: list[tuple], length: int, emit) -> None:
    """One anchor with more contexts than an array holds: several arrays in order
    of position; the windows of each are also looked up in all before it."""
    contexts.sort(key=lambda x: x[0])
    parts: list[list] = [[]]
    size = 0
    for c in contexts:
        if size > ARRAY_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(c)
        size += len(c[2])
    earlier: list[np.ndarray] = []
    for part in parts:
        masks = dict(repeats_in(part, length))
        windows, who, off = _windows(part, length)
        for e in earlier:
            at = np.minimum(np.searchsorted(e, windows), len(e) - 1)
            for k, o in zip(who[hit := e[at] == windows].tolist(), off[hit].tolist()):
                masks.setdefault(k, np.zeros(part[k][1], bool))[o] = True
        emit(part, list(masks.items()))
        earlier.append(np.unique(windows))


# ---- per row: cutting

def united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _cut(batches):
    for b in batches:
        sizes, removed, spans_, kept, texts = [], [], [], [], []
        for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            cuts = united([(s["lo"], s["hi"]) for s in spans or []])
            left, at = [], 0
            for lo, hi in cuts:
                left.append(raw[at:lo])
                at = hi
            left.append(raw[at:])
            rest = b"".join(left)
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            spans_.append(len(cuts))
            kept.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b["id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans_)), pa.array(kept, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _row, spans) of rows (_id, _row, text) that hold repeats."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bloom.size_for(2 * total // (length - GRAM + 2) + 1, 8, MAX_FILTER_BITS)
    seen = bloom.repeated_filter(docs, _anchor_hashes(length), bits, "_id", "_row", "text")
    shards = max(16, total // SHARD_BYTES)
    sent = docs.select("_id", "_row", "text").mapInArrow(_contexts(seen, shards, length), OUT)
    found = sent.groupBy("shard").applyInArrow(_shard(length), "id long, row long, lo long, hi long")
    return stage(found.groupBy(F.col("id").alias("_i"), F.col("row").alias("_r"))
                 .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeat-spans")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("_id").count().filter("count > 1").take(1):
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("_row", F.lit(0).cast("long"))
    spans = repeated_spans(rows, length)
    return (rows.join(spans, (F.col("_id") == F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
            .select("id", "text", "spans")
            .mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
