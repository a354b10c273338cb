"""Empty tables, clashing columns, null and repeated ids; the fuzzy lexicon against plain Levenshtein;
every row of the corpus pipeline followed through its stages."""

import collections
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pricewright.llm import bpe, exact_dedup, ngram_join, near_vectors, packing, quality, suffix_dedup, toxicity, warc
from pricewright.llm._common import stage

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.exact_dedup(docs), ngram_join.ngram_join(docs), bpe.bpe_round_trip(docs, BYTES),
                packing.pack(docs, WORDS), suffix_dedup.suffix_dedup(docs), quality.quality(docs, none),
                toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)),
                near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert not out.collect()
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert not warc.merged_index(warc.read_runs(spark, str(tmp_path / "w"))).collect()


def test_null_and_repeated_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long + " x"), (7, long), (7, "other words entirely " * 9), (8, long), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "kept", 1, "a") for i, t in rows],
                               "doc_id long, text string, component_id string, n_removed int, source string")
    groups = ngram_join.ngram_join(df, n=3, percent=90).collect()
    assert {r.component_id for r in groups if r.doc_id in (7, 8)} == {7}
    assert {r.component_id for r in groups if r.doc_id == 9} == {9}
    cut = suffix_dedup.suffix_dedup(df).collect()
    assert len(cut) == len(rows) and sum(r.n_bytes for r in cut) == sum(len(t or "") for _, t in rows)
    # the text of id 7 stays whole: it is the first of its copies
    assert (7, len(long), 0) in {(r.doc_id, r.n_bytes, r.n_removed) for r in cut}
    assert all(r.n_removed for r in cut if r.doc_id is None or r.doc_id == 8)
    pieces = packing.pack(df, WORDS).collect()
    tok = Tokenizer.from_file(WORDS)
    assert sum(p.length for p in pieces) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    none = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(df, none).count() == len(rows)
    assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, none)).count() == len(rows)


def test_vectors_with_repeated_ids_and_more_columns(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows],
                               "vec_id long, embedding array<double>, label int, n_links int, kept string")
    got = collections.Counter((r.vec_id, r.component_id) for r in near_vectors.near_vectors(df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (None, None): 1}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_lexicon_against_plain_levenshtein():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for _ in range(20):
        terms = {word(rng.randrange(3, 12)): float(rng.randrange(1, 50)) for _ in range(12)}
        stems = {word(rng.randrange(4, 8)): float(rng.randrange(1, 50)) for _ in range(3)}
        lexicon = toxicity.FuzzyLexicon(terms, stems)
        for _ in range(150):
            base = list(rng.choice(list(terms)))
            for _ in range(rng.randrange(4)):
                base.insert(rng.randrange(len(base) + 1), rng.choice("abcd"))
                if rng.random() < 0.7:
                    del base[rng.randrange(len(base))]
            w = "".join(base)
            near = [(distance(w, t), -x) for t, x in terms.items() if distance(w, t) <= toxicity.edits_allowed(len(t))]
            stem = max((x for s, x in stems.items() if w.startswith(s)), default=None)
            want = (-min(near)[1], min(near)[0]) if near else None
            if stem is not None and (want is None or want[1] > 0 or want[0] <= stem):
                want = stem, 0
            assert lexicon.match(w) == want, (w, terms, stems)


def jaccard_groups(texts, n=5, percent=80):
    sets = {i: set(ngram_join.shingles(t, n).tolist()) for i, t in texts.items()}
    owner = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owner[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in {(i, j) for ids in owner.values() for i in ids for j in ids if i < j}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pipeline_rows_are_followed(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now = {r.doc_id: r for r in docs.collect()}
    tables, df = [now], docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        df = stage(step(spark, df, d), "test-" + name.replace(" ", "-"))
        assert df.columns == docs.columns
        rows = df.collect()
        tables.append({r.doc_id: r for r in rows})
        assert len(rows) == len(tables[-1]) and set(tables[-1]) <= set(tables[-2])
    start, clean, single, distinct, masked = tables
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(start) - set(clean)
    labelled = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 0").collect()}
    assert len(gone & labelled) <= 0.02 * len(labelled) and len(toxic & set(clean)) <= 0.5 * max(2, len(toxic))
    # of equal texts the one with the least id stays
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i in sorted(clean):
        first.setdefault(norm(clean[i].text), i)
    assert set(single) == set(first.values()) and all(single[i] == clean[i] for i in single)
    # of similar ones too
    groups = jaccard_groups({i: r.text for i, r in single.items()})
    assert set(distinct) == set(groups.values()) and all(distinct[i] == single[i] for i in distinct)
    # secrets are masked, nothing else changes
    base = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
    assert set(masked) == set(distinct)
    for i, r in masked.items():
        old = distinct[i].text or ""
        if not base.search(old) and "[SECRET]" not in (r.text or ""):
            assert r == distinct[i]
        else:
            assert not base.search((r.text or "").replace("[SECRET]", "\n")) and r.n_chars == len(r.text)
            kept = [p for p in (r.text or "").split("[SECRET]")]
            assert old.startswith(kept[0]) and old.endswith(kept[-1])
    # every token of what is left stands in one place
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, d).collect()
    tok = Tokenizer.from_file(WORDS)
    sizes = {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in masked.items()}
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == sizes
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for s, o, n in places:
        assert s * packing.SEQ_LEN + o == at and o + n <= packing.SEQ_LEN
        at += n


@pytest.mark.parametrize("text", ["x " * 300_000, "a" * 500_000])
def test_very_long_text(spark, text):
    df = spark.createDataFrame([(1, text, "s"), (2, "short", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_bytes for r in suffix_dedup.suffix_dedup(df).collect()} == {1: len(text), 2: 5}
    assert ngram_join.ngram_join(df).filter(F.col("doc_id") == 1).first().component_id == 1
