"""Toxicity scores from a learned lexicon, misspellings included.

1. Lexicon: over all labelled training rows, document counts per class of every
   word and word beginning. Near copies (rows of a class that share a band of
   minima of their word pairs with a hub row and agree with it in most minima)
   count once for each term that any of them has. Words whose excess in toxic documents is large and whose
   precision is high enter the lexicon; a beginning that keeps its precision
   while many words branch off it enters as a stem. Later rounds look only at
   toxic documents in which the lexicon so far finds nothing.
2. Matching: the lexicon is a trie. A Levenshtein automaton runs over a text's
   word and the trie at once; its states (sets of trie node and edits used) are
   built on demand and remembered, so a word costs one step a character and
   ordinary words die after a few. Stems accept any continuation.
3. Context: each hit has a quotation score from its window (inside quote marks,
   words of reporting near by). Evidence splits into abusive and quoted parts,
   exact and misspelled, and a small logistic regression, fitted on labelled
   rows, turns these into a score.

Labels, language, source and id are never inputs. Defined results: null and
empty texts have no evidence and get the base score. With no labelled rows, or
one class only, the lexicon is empty and every score is below 0.5. Extra columns
are ignored; duplicate rows are scored each. Only label 1 counts as toxic."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import join_hot, small_batches, stage, table
from pricewright.llm.ngram_join import shingles

WORD = re.compile(r"\w+")
LONGEST_WORD = 40          # longer ones are not words of a lexicon
STEM_LENGTHS = range(4, 9)
MIN_EXCESS = 8.0           # likelihood ratio statistic of a term, plus 2 ln(labelled rows): more rows, more terms to err on
MIN_PRECISION = 0.7
MIN_STEM_PRECISION = 0.88
MAX_TERMS = 2000           # terms of the lexicon, best first
ROUNDS = 3
MAX_FIT_ROWS = 20_000      # labelled rows of the final regression, by hash
MINIMA, BAND = 64, 4       # independent minima of a text's word pairs, in bands of so many
NEAR = 45                  # minima in which a row agrees with the one it is a near copy of
WINDOW = 6
# Words of reporting, and opening and closing quote marks.
CUES = frozenset("said says say quote quoted quotes wrote writes called word words term terms means phrase "
                 "sagte schrieb zitat wort dit disait mot citation dijo palabra cita".split())
QUOTES = re.compile("[\"“”„«»]")


def edits_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass
class Node:
    next: dict = field(default_factory=dict)
    word: float | None = None
    stem: float | None = None
    edits: int = 0      # most edits any term below allows
    length: int = 0


class FuzzyLexicon:
    """Levenshtein automata and lexicon trie, intersected and determinised on demand."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root = Node()
        for term, weight in words.items():
            self._add(term).word = weight
        for term, weight in stems.items():
            self._add(term).stem = weight
        self.ids: dict[int, Node] = {}
        self.start = self._close({(id(self.root), 0)})
        self.steps: dict[tuple, tuple] = {}
        self.ends: dict = {}

    def _add(self, term: str) -> Node:
        at, edits = self.root, edits_allowed(len(term))
        at.edits = max(at.edits, edits)
        for i, c in enumerate(term):
            at = at.next.setdefault(c, Node())
            at.edits = max(at.edits, edits)
        at.length = len(term)
        return at

    def _close(self, state: set) -> tuple:
        """Add what is reached by leaving out characters of terms."""
        work, least = list(state), {}
        if not self.ids:
            self.ids[id(self.root)] = self.root
        while work:
            n, e = work.pop()
            if least.get(n, 99) <= e:
                continue
            least[n] = e
            for child in self.ids[n].next.values():
                self.ids[id(child)] = child
                if e < child.edits:
                    work.append((id(child), e + 1))
        return tuple(sorted(least.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        out = set()
        for n, e in state:
            node = self.ids[n]
            if e < node.edits:
                out.add((n, e + 1))
            for d, child in node.next.items():
                if d == c:
                    out.add((id(child), e))
                elif e < child.edits:
                    out.add((id(child), e + 1))
        new = self._close(out)
        # a stem that is complete needs nothing more of the word
        best = max((self.ids[n].stem for n, e in new if e == 0 and self.ids[n].stem is not None), default=None)
        return new, best

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term, fewest edits first."""
        if len(word) > LONGEST_WORD:
            return None
        state, stem = self.start, None
        for c in word:
            got = self.steps.get((state, c))
            if got is None:
                if len(self.steps) > 400_000:
                    self.steps.clear()
                got = self.steps[state, c] = self._step(state, c)
            state = got[0]
            if got[1] is not None and (stem is None or got[1] > stem):
                stem = got[1]
            if not state:
                break
        best = (stem, 0) if stem is not None else None
        if state:
            end = self.ends.get(state, 0)
            if end == 0:
                end = self.ends[state] = self._end(state)
            if end and (best is None or end[1] == 0 and end[0] > best[0]):
                best = end
        return best

    def _end(self, state: tuple):
        hits = [(e, -self.ids[n].word) for n, e in state
                if self.ids[n].word is not None and e <= edits_allowed(self.ids[n].length)]
        return (-min(hits)[1], min(hits)[0]) if hits else None


def _terms(text: str | None) -> set[str]:
    """The words, after a blank, and word beginnings of a text."""
    words = {w for w in WORD.findall((text or "").lower()) if 3 <= len(w) <= LONGEST_WORD}
    return {" " + w for w in words} | {w[:n] for n in STEM_LENGTHS for w in words if len(w) >= n}


def _count_terms(batches):
    """Documents per word ('w') and word beginning ('s') and class, summed per task."""
    seen = {0: Counter(), 1: Counter()}

    def flush():
        keys = list({*seen[0], *seen[1]})
        rows = [(k, seen[1][k], seen[0][k]) for k in keys]
        seen[0].clear()
        seen[1].clear()
        for i in range(0, len(rows), 50_000):
            part = rows[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()),
                 pa.array([r[2] for r in part], pa.int64())], names=["term", "bad", "good"])

    for b in batches:
        for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            seen[toxic].update(_terms(text))
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield from flush()
    yield from flush()


def _family_terms(batches):
    """Words and word beginnings per family and class, each once per task."""
    seen: dict[tuple, set] = {}

    def flush():
        rows = [(f, c, t) for (f, c), terms in seen.items() for t in terms]
        seen.clear()
        for i in range(0, len(rows), 50_000):
            f, c, t = zip(*rows[i:i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int32()), pa.array(t, pa.string())],
                                             names=["family", "toxic", "term"])

    held = 0
    for b in batches:
        for text, *key in zip(b["text"].to_pylist(), b["family"].to_pylist(), b["toxic"].to_pylist()):
            terms = seen.setdefault(tuple(key), set())
            held -= len(terms)
            terms |= _terms(text)
            held += len(terms)
            if held > 400_000:
                yield from flush()
                held = 0
    yield from flush()


_FACTORS = np.random.default_rng(9).integers(0, 2 ** 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(text: str | None) -> np.ndarray:
    """Least values of the word pairs under independent hashes; without words all are the largest value."""
    least = np.full(MINIMA, 2 ** 64 - 1, np.uint64)
    pairs = shingles(text, 2)
    for i in range(0, len(pairs), 2000):
        least = np.minimum(least, (pairs[i:i + 2000, None] * _FACTORS).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def _signatures(batches):
    for b in batches:
        got = [minima(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["node"], b["doc_id"], b["toxic"], pa.array([m.tobytes() for m in got], pa.binary())],
                                         names=["node", "doc_id", "toxic", "minima"])


def _near(batches):
    """Those of the pairs whose minima agree."""
    for b in batches:
        ok = [int((np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum()) >= NEAR
              for x, y in zip(b["mine"].to_pylist(), b["other"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["node"], b["hub"]], names=["node", "hub"]).filter(pa.array(ok, pa.bool_()))


def families(labelled: DataFrame) -> DataFrame:
    """(node, doc_id, toxic, family, alone): a node is a distinct text of a class,
    doc_id one of its rows. Nodes that share a band are compared with the least of
    them; a node joins the family of the least it is a near copy of. Similarity is
    not passed on from node to node, so all of a family are like one text."""
    kind = dict(labelled.dtypes)["doc_id"]
    nodes = (labelled.mapInArrow(_signatures, f"node long, doc_id {kind}, toxic int, minima binary")
             .groupBy("node", "toxic").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"),
                                           F.max("minima").alias("minima")))
    nodes = stage(nodes, "toxic-nodes")
    bands = [F.xxhash64(F.lit(i), "toxic", F.expr(f"substring(minima, {4 * BAND * i + 1}, {4 * BAND})"))
             for i in range(MINIMA // BAND)]
    keys = nodes.select("node", F.explode(F.array(*bands)).alias("key"))
    hubs = stage(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
                 "toxic-hubs")
    pairs = stage(join_hot(keys, hubs, "key", "n").filter("node <> hub").select("node", "hub").distinct(), "toxic-pairs")
    sizes = stage(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
                  .join(nodes.select(F.col("node").alias("hub"), F.col("minima").alias("other")), "hub"), "toxic-hubs")
    both = join_hot(pairs, sizes, "hub", "n").join(nodes.select("node", F.col("minima").alias("mine")), "node")
    found = (both.select("node", "hub", "mine", "other").mapInArrow(_near, "node long, hub long")
             .groupBy("node").agg(F.min("hub").alias("hub")))
    placed = stage(nodes.drop("minima").join(found, "node", "left").withColumn("family", F.coalesce("hub", "node"))
                   .drop("hub"), "toxic-families")
    size = stage(placed.groupBy("family").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n")), "toxic-families")
    return stage(join_hot(placed.drop("n"), size, "family", "n")
                 .select("node", "doc_id", "toxic", "family", (F.col("rows") == 1).alias("alone")), "toxic-families")


def _pick(rows: list, n: dict, words: dict, stems: dict) -> None:
    """Add terms to the lexicon, the weights being log odds ratios."""
    weight = lambda r: math.log((r.bad + 0.5) / (r.good + 0.5) * (n[0] + 1) / (n[1] + 1))
    start = {r.term: r for r in rows if not r.term.startswith(" ")}
    whole = {r.term[1:]: r for r in rows if r.term.startswith(" ")}
    child: dict[str, int] = {}
    for t, r in start.items():
        child[t[:-1]] = max(child.get(t[:-1], 0), r.bad)
    covered = lambda t: any(t[:k] in stems for k in STEM_LENGTHS)
    for t in sorted(start, key=len):
        r = start[t]
        if (len(t) < STEM_LENGTHS[-1] and r.precision >= MIN_STEM_PRECISION and not covered(t)
                and max(child.get(t, 0), whole[t].bad if t in whole else 0) < 0.8 * r.bad):
            stems[t] = weight(r)
    for t, r in whole.items():
        if not covered(t):
            words[t] = weight(r)


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems from rows (doc_id, text, toxic 0/1)."""
    node = F.xxhash64("text", "toxic").alias("node")
    chosen = families(labelled.select(node, "doc_id", "toxic", "text"))
    n = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    if not n.get(0) or not n.get(1):
        return words, stems
    rows = stage(labelled.select(node, "doc_id", "text").join(chosen, ["doc_id", "node"])
                 .select("text", "toxic", "family", "alone"), "toxic-rows")

    def count(df: DataFrame) -> DataFrame:
        single = df.filter("alone").mapInArrow(_count_terms, "term string, bad long, good long")
        shared = (df.filter("NOT alone").mapInArrow(_family_terms, "family long, toxic int, term string").distinct()
                  .select("term", F.col("toxic").cast("long").alias("bad"), (1 - F.col("toxic")).cast("long").alias("good")))
        return single.unionByName(shared).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    every = stage(count(rows), "toxic-terms")
    counts, toxic = every, n[1]
    least = MIN_EXCESS + 2 * math.log(n[0] + n[1])
    for _ in range(ROUNDS):
        share = toxic / (n[0] + toxic)
        a, c = F.col("bad"), F.col("good")
        excess = 2 * (F.when(a > 0, a * F.log(a / ((a + c) * share))).otherwise(0)
                      + F.when(c > 0, c * F.log(c / ((a + c) * (1 - share)))).otherwise(0))
        found = (counts.withColumn("excess", excess).withColumn("precision", (a + 0.5) / (a + c + 1))
                 .filter((F.col("excess") >= least) & (F.col("precision") >= MIN_PRECISION))
                 .orderBy(F.desc("excess"), "term").limit(MAX_TERMS).collect())
        if not found:
            break
        _pick(found, {0: n[0], 1: toxic}, words, stems)
        if len(words) + len(stems) >= MAX_TERMS:
            break
        silent = stage(rows.filter("toxic = 1").mapInArrow(_without_hit(words, stems), rows.schema), "toxic-silent")
        toxic = silent.select("family").distinct().count()
        if toxic < 3:
            break
        counts = count(silent).drop("good").join(every.select("term", "good"), "term")
    return words, stems


def _without_hit(words: dict, stems: dict):
    def run(batches):
        lexicon, clean = FuzzyLexicon(words, stems), set()
        for b in batches:
            none = [not evidence(lexicon, t or "", clean)[-1] for t in b["text"].to_pylist()]
            yield b.filter(pa.array(none, pa.bool_()))
    return run


def _quotation(text: str, spans: list[tuple[int, int]], words: list[str], i: int) -> float:
    """0 (said by the author) to 1 (quoted) for the word i."""
    lo, hi = spans[i]
    left, right = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
    left, right = max(left, lo - 300), min(right if right >= 0 else len(text), hi + 300)
    inside = len(QUOTES.findall(text[left:lo])) % 2 == 1 and QUOTES.search(text[hi:right]) is not None
    cue = any(w in CUES for w in words[max(0, i - WINDOW):i + WINDOW + 1])
    return 0.6 * inside + 0.4 * cue


def evidence(lexicon: FuzzyLexicon, text: str, clean: set) -> tuple[float, ...]:
    """Abusive exact, abusive misspelled, quoted, and hits per word. ``clean``
    remembers words without a match."""
    low = text.lower()
    new = set(WORD.findall(low)) - clean
    hits = {}
    for w in new:
        m = lexicon.match(w)
        if m:
            hits[w] = m
    clean.update(new - hits.keys())
    if len(clean) > 300_000:
        clean.clear()
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    found = list(WORD.finditer(low))
    words, spans = [m.group() for m in found], [m.span() for m in found]
    exact = fuzzy = quoted = 0.0
    n = 0
    for i, w in enumerate(words):
        if w in hits:
            weight, edits = hits[w]
            q = _quotation(low, spans, words, i)
            n += 1
            quoted += weight * q
            if edits:
                fuzzy += weight * (1 - q)
            else:
                exact += weight * (1 - q)
    return math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100.0 * n / len(words))


FEATURES = ["exact", "misspelled", "quoted", "density"]


def fit_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -1.0
    if 0 < y.sum() < len(y):
        pull = np.full(x.shape[1], ridge)
        pull[-1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
    return w


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]

    def scorer(self):
        """Function of a text: (score, evidence); holds one task's lexicon."""
        lexicon, clean, w = FuzzyLexicon(self.words, self.stems), set(), np.array(self.weights)

        def score(text: str | None) -> tuple:
            x = evidence(lexicon, text or "", clean)
            z = float(np.dot(w[:-1], x) + w[-1])
            return (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *x)
        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
                 max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic) that do not meet ``held_out``, a condition on the id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("_id").agg(F.when(F.max("toxic") == 1, 1).otherwise(0).alias("toxic")))
    if held_out is not None:
        known = known.filter(~held_out(F.col("_id")))
    labelled = texts.join(stage(known, "toxic-labels"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    words, stems = learn_lexicon(labelled)

    def run(batches):
        score = Model(words, stems, [0.0] * 5).scorer()
        for b in batches:
            got = [score(t)[1:] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["h"], b["toxic"]] + [pa.array([g[k] for g in got], pa.float64()) for k in range(4)],
                names=["h", "toxic", *FEATURES])
    seen = labelled.select(F.xxhash64("doc_id").alias("h"), "toxic", "text").mapInArrow(
        run, "h long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    fit = seen.orderBy("h", *FEATURES).limit(max_fit_rows).toPandas()
    return Model(words, stems, fit_regression(fit[FEATURES].to_numpy(float), fit["toxic"].to_numpy(float)).tolist())


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, and the evidence) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        score = model.scorer()
        for b in batches:
            got = [score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"]] + [pa.array([g[k] for g in got], pa.float64()) for k in range(5)],
                names=["doc_id", "score", *FEATURES])
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, f"doc_id {kind}, score double, " + ", ".join(f"{f} double" for f in FEATURES))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model.scorer()
        for texts in parts:
            yield pd.Series([f(t)[0] for t in texts], dtype="float64")
    return docs.filter(score(F.col(text_col).cast("string")) < 0.5)


def in_fold(id_col, folds: int, fold: int):
    """Condition: crc32 of the id as text falls into the fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: in_fold(i, 5, 0))
    return score_toxicity(docs, model).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                                              "predicted", *FEATURES)
