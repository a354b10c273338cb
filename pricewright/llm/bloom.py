"""Filter of hashes that occur twice or more, built in two passes.

Every task counts the bit positions of its own hashes and sends, for each
segment of the filter, which positions it saw once and which more often. A
group per segment adds these up; a bit is set when its position was hit at
least twice. A hash that occurs twice has all its bits set, so the filter never
misses one; a unique hash passes with a small probability that later stages
must expect. The filter has at most ``max_bits`` bits at any input size: beyond
that it lets more unique hashes pass, and results stay the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 18
FLUSH = 1 << 21


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each 64-bit hash; bits is a power of two."""
    h = h.astype(np.uint64, copy=False)
    a = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(21)
    return a & np.uint64(bits - 1), b & np.uint64(bits - 1)


def _flush(parts: list[np.ndarray]):
    pos, n = np.unique(np.concatenate(parts), return_counts=True)
    seg = pos // np.uint64(SEGMENT_BITS)
    off = (pos % np.uint64(SEGMENT_BITS)).astype("<u4")
    cuts = np.flatnonzero(np.diff(seg)) + 1
    bounds = np.concatenate([[0], cuts, [len(pos)]])
    segs, once, twice = [], [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        o, c = off[lo:hi], n[lo:hi]
        segs.append(int(seg[lo]))
        once.append(o[c == 1].tobytes())
        twice.append(o[c > 1].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(segs, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        names=["seg", "once", "twice"])


def _merge(t: pa.Table) -> pa.Table:
    n = np.zeros(SEGMENT_BITS, np.uint8)
    for o, w in zip(t["once"], t["twice"]):
        o, w = np.frombuffer(o.as_py(), "<u4"), np.frombuffer(w.as_py(), "<u4")
        n[o] = np.minimum(n[o] + 1, 2)
        n[w] = 2
    return pa.table({"seg": pa.array([t["seg"][0].as_py()], pa.int64()),
                     "bits": pa.array([np.packbits(n >= 2, bitorder="little").tobytes()], pa.binary())})


def size_for(n: int, bits_per_key: int, max_bits: int) -> int:
    want = max(SEGMENT_BITS, n * bits_per_key)
    return min(1 << (want - 1).bit_length(), max_bits)


def repeated_filter(df: DataFrame, hashes, bits: int, *columns: str) -> Broadcast:
    """Broadcast bit array of the hashes that may occur twice. ``hashes`` maps
    an Arrow batch of ``columns`` to one or more uint64 arrays."""

    def scan(batches):
        parts, held = [], 0
        for b in batches:
            for h in hashes(b):
                a, c = positions(h, bits)
                parts += [a, c]
                held += 2 * len(h)
                if held >= FLUSH:
                    yield _flush(parts)
                    parts, held = [], 0
        if held:
            yield _flush(parts)

    rows = (df.select(*columns).mapInArrow(scan, "seg long, once binary, twice binary")
            .groupBy("seg").applyInArrow(_merge, "seg long, bits binary").collect())
    out = bytearray(bits // 8)
    for r in rows:
        out[r.seg * SEGMENT_BITS // 8:(r.seg + 1) * SEGMENT_BITS // 8] = r.bits
    return df.sparkSession.sparkContext.broadcast(bytes(out))


def maybe_repeated(filter_bytes: bytes, h: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_bytes, np.uint8)
    a, b = positions(h, len(bits) * 8)
    hit = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)
