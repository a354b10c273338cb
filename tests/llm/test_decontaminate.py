"""Benchmark decontamination against a plain-Python version."""

import hashlib
import random
import re

import pytest

from pricewright.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def windows(text, n=10):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, items, n=10):
    owners = {}
    for i, t in items:
        for win in windows(t, n):
            owners.setdefault(win, set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in owners.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["Ab", "cé", "d9", "e", "ΣΑ", "g", "h"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", "_\n", "\x00 ", " ’ "[1:]]) for _ in range(n))
    items = [(1, text(30)), (2, text(14)), (3, "Rare Word"), (4, ""), (5, None), (6, "--"), (None, text(12)), (2, text(11)),
             (70, "solo"), (8, None)]
    items.append((9, items[0][1].upper()))
    docs = [(1, None), (2, ""), (3, " .. "), (4, items[0][1]), (5, "x " + items[1][1].lower() + " y"), (5, "rare,word"),
            (5, "rare,word"), (None, "RARE word solo"), (6, "rareword"), (7, items[0][1] * 3 + items[1][1]),
            (8, "a" * 5000), (9, text(3000) + items[6][1] + text(20))]
    docs += [(100 + k, text(rng.randrange(1, 60)) + (items[k % 2][1][:90] if k % 3 == 0 else "")) for k in range(60)]
    return docs, items


def frames(spark, rows):
    docs, items = rows
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, items int, n_hit string").repartition(3),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"))


@pytest.mark.parametrize("n,segment", [(10, D.SEGMENT), (10, 12), (3, D.SEGMENT)])
def test_contamination(spark, rows, n, segment):
    docs, items = frames(spark, rows)
    got = D.contamination(docs, items, n=n, segment=segment).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in got), key=str) == brute(*rows, n=n)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_empty_tables(spark, rows):
    docs, items = frames(spark, rows)
    assert not D.contamination(docs.limit(0), items).collect()
    clean = D.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(rows[0]) and not any(r.contaminated for r in clean)


def test_removal(spark, rows):
    docs, items = frames(spark, rows)
    hit = {str((r.doc_id, r.n_words)) for r in D.contamination(docs, items).collect() if r.contaminated}
    kept = D.decontaminate(docs, items, remove="documents")
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        str((i, t)) for i, t in rows[0] if str((i, len(words(t)))) not in hit)
    cut = D.decontaminate(docs, items, remove="spans").collect()
    assert len(cut) == len(rows[0])
    left = {(r.doc_id, r.text) for r in cut}
    assert all((i, t) in left for i, t in rows[0] if str((i, len(words(t)))) not in hit)
    after = {r.doc_id: words(r.text) for r in cut if r.doc_id is not None and r.doc_id != 5}
    for r in D.contamination(docs, items).collect():
        if r.doc_id is not None and r.doc_id != 5:
            w = words(dict(rows[0])[r.doc_id])
            assert after[r.doc_id] == [x for k, x in enumerate(w) if not any(s.start <= k < s.end for s in r.spans)]
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="words")


def test_digest_of_items(spark, rows, tmp_path):
    docs, items = frames(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = D.op11_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.items_sha256) for r in got) == sorted(
        (str(i), hashlib.sha256(",".join(f).encode()).hexdigest()) for i, _, _, f in brute(*rows))
