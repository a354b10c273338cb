"""Periodic runs against a plain version that tries every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pricewright.llm import periodic_runs as P


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(13)
    out = [[], [0], [0] * 11, [0] * 12, [0] * 300, [0, 1] * 40, [0, 0, 1] * 30 + [2] + [0, 0, 1] * 9]
    for k in range(120):
        alphabet = rng.choice([1, 2, 2, 3, 5, 40])
        s = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 200))]
        if k % 2:
            p = rng.randrange(1, 60)
            s += [rng.randrange(alphabet) for _ in range(p)] * rng.randrange(2, 7) + s[:20]
        out.append(s)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    return out + [fib[-1], [7] * 500 + [8] + [7] * 500]


def test_find_runs():
    texts = sequences()
    assert P.find_runs([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]
    assert P.find_runs([np.array(t, np.int64) for t in texts], group=1) == [brute(t) for t in texts]


@pytest.mark.parametrize("step", [1, 3, 64])
def test_words_arrive_online(step):
    for t in sequences()[4:40]:
        whole, catcher = brute(t), P.SquareCatcher(max(len(t), 1))
        for lo in range(0, len(t), step):
            for s, e, q in catcher.append(np.array(t[lo:lo + step], np.int64)):
                assert e - s >= 2 * q and e <= lo + step and t[s:e - q] == t[s + q:e]
        assert [(s, e - s, q) for s, e, q in catcher.runs()] == whole


def test_squares_are_reported_when_they_end():
    catcher, seen = P.SquareCatcher(100), None
    for i, w in enumerate(list(range(20)) * 2 + [99]):
        for s, e, q in catcher.append(np.array([w])):
            seen = seen or (i, s, e, q)
    assert seen == (39, 0, 40, 20)


def test_long_text_of_one_word():
    n = 400_000
    assert P.find_runs([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    words = np.tile(np.arange(1000), 300)
    assert P.find_runs([words]) == [[(0, 300_000, 1000)]]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (None, "a " * 30), (None, None), (4, "a b c\x85d " * 9), (4, "a b c\x85d " * 9)]
    for i in range(10, 260):
        rows.append((i, rng.choice([" ", "\n", " \x0c"]).join(rng.choice(["x", "yé", "z", "😀"]) for _ in range(rng.randrange(0, 150)))))
    rows.append((500, " ".join(str(rng.randrange(50)) for _ in range(3000))))
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, start int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op13_periodic_runs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in map(lambda r: expected(*r), rows)) >= 15
    out = P.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "start", "runs", "collapsed"] and out.count() == len(rows)
    assert not P.periodic_runs(df.limit(0)).collect()


def test_long_texts_are_taken_in_slices():
    """What a task holds at once does not grow with the texts of a batch."""
    import pyarrow as pa

    from pricewright.llm.periodic_runs import WORK, _runs_of, _slices
    texts = ["a b c " * 2000, None, "", "x " * WORK, "y z " * 100] + ["w%d " % i * 40 for i in range(30)]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "id"])
    parts = list(_slices([b, b.slice(0, 0)]))
    assert sum((p.column(1).to_pylist() for p in parts), []) == list(range(len(texts)))
    assert len(parts) > 1 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= WORK for p in parts)
    alone = [r for i in range(len(texts)) for o in _runs_of([b.slice(i, 1)]) for r in o.to_pylist()]
    assert [r for o in _runs_of([b]) for r in o.to_pylist()] == alone
