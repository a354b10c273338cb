"""Near-duplicate vectors by a robust-pruned flat graph.

1. Copies (same label, same components) become one node with a count.
2. Each label's vectors are cut into overlapping shards around k-means centres
   fitted on a bounded sample (``SAMPLE`` vectors by hash, per round). The nearest
   centre is a vector's home; it also visits the shards where a vector at the
   threshold's angle may be at home. Of that angle only the part along the line
   between two centres counts, in d dimensions typically a share of 1 / sqrt(d);
   ``SPREAD`` times that share is allowed, which a few shards meet, where the
   whole angle would meet nearly all. Shards that are still too large are cut
   again, with their visitors, so a label may hold any part of the rows.
3. Each shard builds a flat graph of its members, visitors included: candidate
   neighbours by similarity, then robust pruning (a candidate goes if a chosen
   neighbour is ``ALPHA`` times nearer to it than the node is). A shard that could
   not be cut builds it in pieces of bounded size that overlap by half. A vector's
   adjacency lists from all its shards and pieces are united.
4. Each shard answers for its members, dealt into blocks, over the united lists:
   greedy beam search from the medoid, then the range expands from what was found
   (and from the node itself) as long as neighbours stay within reach.
5. Pairs found are verified by cosine in double precision. A node's link counts
   at the other node's home, so once. Blocks send counts and a spanning forest,
   never all pairs.

The graph search may miss pairs; ``audit_recall`` measures it against brute
force (queries: ids divisible by 100, against all rows).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or id, link with nothing. Vectors of
different length never link. Rows that share an id are one node of the links.
An empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import join_hot, shuffle_width, stage, table
from pricewright.llm.graph import components

SHARD = 600             # vectors per centre aimed at
CAPACITY = 4000         # a shard above this is cut again
SAMPLE = 16_384         # vectors that centres are fitted on, per round
QUERIES = 4000          # vectors that a task looks up in a cell
ROUNDS = 6
DEGREE = 24
POOL = 72               # candidate neighbours before pruning
ALPHA = 1.2
PRUNED = 512            # nodes pruned at once
PRODUCT = 2 * CAPACITY  # nodes of a shard up to which a search has all similarities made at once
BEAM = 12
REACH = 0.06            # the range expands through vectors this much below the threshold
SPREAD = 2.0            # standard deviations of a near vector's shift along one direction
CENTRES = 1024          # of one cell and round


def unit(rows) -> np.ndarray:
    m = np.array([np.frombuffer(r, "<f8") for r in rows])
    m = m / np.abs(m).max(axis=1, keepdims=True)      # squares of extreme components would not be numbers
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# ---- cells

def _fit(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Centres on the unit sphere; k seeds spread over the sample."""
    k = max(1, min(k, len(points), CENTRES))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        for j in range(k):
            own = points[near == j]
            if len(own):
                c = own.sum(0)
                if (n := np.linalg.norm(c)) > 0:
                    centres[j] = c / n
    return centres


def _assign(centres: dict[str, np.ndarray], margin: float):
    def run(batches):
        for b in batches:
            cells, rows, home = [], [], []
            names = np.array(b["cell"].to_pylist(), object)
            for cell in set(names.tolist()):
                own = np.flatnonzero(names == cell)
                c = centres[cell]
                near = unit([b["vec"][int(i)].as_py() for i in own]) @ c.T
                best = near.argmax(1)
                apart = np.sqrt(np.maximum(2 - 2 * (c[best] @ c.T), 0))
                share = min(1.0, SPREAD / math.sqrt(c.shape[1]))
                # what lies beyond the plane between two centres is at least as far as the plane
                reach = near[np.arange(len(own)), best][:, None] - near <= margin * share * apart + 1e-9
                i, j = np.nonzero(reach)
                cells += [f"{cell}/{x}" for x in j.tolist()]
                rows += own[i].tolist()
                home += (j == best[i]).tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.string()), *(b[c].take(take) for c in ("id", "vec", "n")),
                 pc.and_(b["home"].take(take), pa.array(home, pa.bool_()))], names=["cell", "id", "vec", "n", "home"])
    return run


def shards(nodes: DataFrame, threshold: float) -> DataFrame:
    """(cell, id, vec, n, home): nodes (cell, id, vec, n) at home in one cell and visiting those in reach."""
    margin = math.sqrt(1 - threshold * threshold) if 0 <= threshold < 1 else 0.0 if threshold >= 1 else 2.0
    done, now = None, nodes.withColumn("home", F.lit(True))
    for r in range(ROUNDS):
        sizes = now.filter("home").groupBy("cell").count()
        large = sizes.filter(F.col("count") > (SHARD if r == 0 else CAPACITY))
        big = stage(large, "vec-cells")
        if not big.take(1):
            break
        over = now.join(big, "cell")
        small = now.join(big, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        sample: dict[str, list] = {}
        want: dict[str, int] = {}
        for row in over.filter("home").orderBy(F.xxhash64("id", "cell")).limit(SAMPLE).collect():
            sample.setdefault(row["cell"], []).append(row["vec"])
            want[row["cell"]] = row["count"]
        centres = {c: _fit(unit(v), -(-want[c] // SHARD)) for c, v in sample.items()}
        # a cell without a sampled vector waits for the next round
        cut = over.filter(F.col("cell").isin(list(centres))).select("cell", "id", "vec", "n", "home")
        later = over.filter(~F.col("cell").isin(list(centres))).select("cell", "id", "vec", "n", "home")
        now = stage(cut.mapInArrow(_assign(centres, margin), "cell string, id long, vec binary, n long, home boolean")
                    .unionByName(later).dropDuplicates(["cell", "id", "home"]), "vec-shards")
    return now if done is None else done.unionByName(now)


# ---- graph

def prune(sims: np.ndarray, near: np.ndarray, first: int = 0, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning by squared distance 2 - 2 s: which of its candidates each node keeps. Row i of
    ``near`` has those of node ``first`` + i, most similar first. A rank is gone through for all
    nodes at once."""
    chosen, alive = np.zeros(near.shape, bool), np.ones(near.shape, bool)
    to_node = 2 - 2 * np.take_along_axis(sims[first:first + len(near)], near, 1)
    for k in range(near.shape[1]):
        i = np.flatnonzero(alive[:, k])
        chosen[i, k] = True
        alive[i[chosen[i].sum(1) == degree]] = False        # complete
        i = i[alive[i, k]]
        between = sims[near[i, k][:, None], near[i, k + 1:]]
        alive[i, k + 1:] &= alpha * alpha * np.maximum(2 - 2 * between, 0) > to_node[i, k + 1:]
    return chosen


def _build(t: pa.Table) -> pa.Table:
    ids = t["id"].to_numpy()
    v = unit(t["vec"].to_pylist())
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    pool = min(POOL, len(ids) - 1)
    out: list[set] = [set() for _ in ids]
    if pool > 0:
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        kept = np.concatenate([prune(sims, near[lo:lo + PRUNED], lo) for lo in range(0, len(ids), PRUNED)])
        for i, j in zip((x := np.nonzero(kept))[0].tolist(), near[x].tolist()):
            out[i].add(j)
            if len(out[j]) < 2 * DEGREE:
                out[j].add(i)       # and back, so that all nodes can be reached
    return pa.table({"id": pa.array(ids, pa.int64()),
                     "near": pa.array([ids[sorted(o)].tolist() for o in out], pa.list_(pa.int64()))})


def _search(threshold: float):
    def run(t: pa.Table, asked: pa.Table) -> pa.Table:
        ids, n, at_home = t["id"].to_numpy(), t["n"].to_numpy(), np.array(t["home"].to_pylist(), bool)
        if not len(ids) or not asked.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                             "root": pa.array([], pa.int64())})
        v = unit(t["vec"].to_pylist())
        place = {int(i): k for k, i in enumerate(ids)}
        lists = [[place[x] for x in p if x in place] for p in t["near"].to_pylist()]
        wide = max([1, *map(len, lists)])
        graph = np.full((len(ids), wide), -1)
        for k, row in enumerate(lists):
            graph[k, :len(row)] = row
        names, w = asked["name"].to_numpy(), unit(asked["asked"].to_pylist())
        own = np.array([place[int(i)] for i in names])
        # nodes of the forest: first the cell's, then the asked ones
        counts, links, size = np.zeros(len(names), np.int64), [], len(ids) + len(names)
        for lo in range(0, len(names), 256):
            hits = _range(v, graph, w[lo:lo + 256], own[lo:lo + 256], threshold - REACH)
            a, b = hits[0] + lo, hits[1]
            other = at_home[b] & (names[a] != ids[b])
            a, b = a[other], b[other]
            # verify in double precision
            ok = np.einsum("ij,ij->i", w[a], v[b]) >= threshold
            np.add.at(counts, a[ok], n[b[ok]])
            links += zip((a[ok] + len(ids)).tolist(), b[ok].tolist())
        every = np.concatenate([ids, names])
        parent = list(range(size))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        for x, y in links:
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = [int(every[find(k)]) for k in range(size)]
        counts = np.concatenate([np.zeros(len(ids), np.int64), counts])
        return pa.table({"id": pa.array(every, pa.int64()), "links": pa.array(counts, pa.int64()),
                         "root": pa.array(roots, pa.int64())})
    return run


def _range(v: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, node) pairs reached with similarity of at least ``floor``; ``own``
    is the place of a queried vector among the nodes. Of a usual shard all similarities are
    made in one product, which takes less time than to gather the vectors of those asked for."""
    size, rows = len(v), np.arange(len(q))
    sims = q @ v.T if size <= PRODUCT else None
    sim = lambda r, c: np.einsum("ij,ij->i", q[r], v[c]) if sims is None else sims[r, c]

    def beside(r, c, seen):
        """The neighbours of nodes c that are new to the queries r."""
        if sims is None:
            rr, nn = np.repeat(r, graph.shape[1]), graph[c].ravel()
            rr, nn = np.divmod(np.unique((rr * size + nn)[nn >= 0]), size)
            return rr[new := ~seen[rr, nn]], nn[new]
        new = np.zeros((len(q), size + 1), bool)        # the last column takes the ends of short lists
        new[r[:, None], graph[c]] = True
        new = new[:, :size]
        new &= ~seen
        return np.divmod(np.flatnonzero(new), size)

    medoid = int((v @ v.mean(0)).argmax())
    seen = np.zeros((len(q), size), bool)
    # greedy: expand the BEAM best nodes of each query until they stay the same
    beam = np.full((len(q), 1), medoid)
    score = (q @ v[medoid])[:, None]
    done = np.zeros((len(q), size), bool)
    for _ in range(size):
        open_ = ~np.take_along_axis(done, beam, 1)
        if not open_.any():
            break
        r, c = np.nonzero(open_)
        done[r, beam[r, c]] = True
        rr, nn = beside(r, beam[r, c], seen)
        seen[rr, nn] = True
        s = sim(rr, nn)
        better = s >= score[rr, -1] if beam.shape[1] == BEAM else np.ones(len(rr), bool)   # others leave at once
        rr, nn, s = rr[better], nn[better], s[better]
        best = np.full((len(q), BEAM), -1)
        top = np.full((len(q), BEAM), -3.0)
        rr, nn = np.concatenate([np.repeat(rows, beam.shape[1]), rr]), np.concatenate([beam.ravel(), nn])
        s = np.concatenate([score.ravel(), s])
        code, first = np.unique(rr * size + nn, return_index=True)
        rr, nn, s = rr[first], nn[first], s[first]
        order = np.lexsort((nn, -s, rr))
        rr, nn, s = rr[order], nn[order], s[order]
        rank = np.arange(len(rr)) - np.searchsorted(rr, rr, "left")
        keep = rank < BEAM
        best[rr[keep], rank[keep]] = nn[keep]
        top[rr[keep], rank[keep]] = s[keep]
        short = best < 0
        best[short] = np.broadcast_to(best[:, :1], best.shape)[short]
        top[short] = -3.0
        beam, score = best, top
    # the range: from what the search found near, and from the node itself
    found = np.zeros((len(q), size), bool)
    r, c = np.divmod(np.arange(beam.size), beam.shape[1])
    near = sim(r, beam[r, c]) >= floor
    found[r[near], beam[r[near], c[near]]] = True
    found[rows, own] = True
    r, c = np.nonzero(found)
    while len(r):
        rr, nn = beside(r, c, found)
        near = sim(rr, nn) >= floor
        r, c = rr[near], nn[near]
        found[r, c] = True
    return np.nonzero(found)


def _doubles(batches):
    for b in batches:
        vecs = [np.array(x, "<f8").tobytes() for x in b["vec"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], b["cell"], b["key"], pa.array(vecs, pa.binary())],
                                         names=["id", "cell", "key", "vec"])


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, cell, key, vec) of rows that can link; vec is little-endian doubles."""
    x = F.col(vec_col).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(x) > 0)
            & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
            & F.exists(x, lambda c: c != 0))
    return (vectors.filter(F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.concat_ws("|", F.col(label_col).cast("string"), F.size(x).cast("string")).alias("cell"),
                    F.concat_ws("|", F.col(label_col).cast("string"), F.xxhash64(x).cast("string"),
                                F.xxhash64(F.reverse(x), F.lit(1)).cast("string")).alias("key"), x.alias("vec"))
            .mapInArrow(_doubles, "id long, cell string, key string, vec binary"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = dict(vectors.dtypes)[id_col]
    rows = stage(usable(vectors, id_col, vec_col, label_col), "vec-rows")
    nodes = stage(rows.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"),
                                          F.first("cell").alias("cell"), F.first("vec").alias("vec")), "vec-nodes")
    member = shards(nodes.select("cell", F.col("node").alias("id"), "vec", F.col("size").alias("n")), threshold)
    member = stage(member, "vec-members")
    size = F.count(F.lit(1))
    blocks = stage(member.groupBy("cell").agg(F.ceil(size / QUERIES).cast("int").alias("blocks"),
                                              F.ceil(2 * size / CAPACITY).cast("int").alias("pieces")), "vec-blocks")
    first = F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces"))
    piece = F.when(F.col("pieces") <= 2, F.array(F.lit(0).cast("long"))).otherwise(
        F.array(first, F.pmod(first + 1, F.col("pieces"))))
    lists = (member.join(blocks, "cell").select("cell", F.explode(piece).alias("piece"), "id", "vec")
             .groupBy("cell", "piece").applyInArrow(_build, "id long, near array<long>"))
    # at most 2 * DEGREE neighbours from each shard or piece
    united = stage(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vec-lists")
    ready = (member.join(united, "id").join(blocks, "cell")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", "block", "id", "vec", "n", "home", "near"))
    asked = (member.select("cell", "id", "vec").join(blocks, "cell")
             .select(F.col("cell").alias("of"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"),
                     F.col("id").alias("name"), F.col("vec").alias("asked")))
    found = stage(ready.groupBy("cell", "block").cogroup(asked.groupBy("of", "part"))
                  .applyInArrow(_search(threshold), "id long, links long, root long"), "vec-found")
    joined = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_node = (found.groupBy("id").agg(F.sum("links").alias("links"))
                .join(joined, "id", "left").withColumnRenamed("id", "_node"))
    copies = join_hot(rows.select("id", "key"), nodes.select("key", "node", "size"), "key", "size")
    out = (copies.join(per_node, F.col("node") == F.col("_node"), "left")
           .select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                   F.coalesce("component", "node").alias("component_id")))
    out = out.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (vectors.select(F.col(id_col).alias("vec_id")).join(out, F.col("vec_id") == F.col("id"), "left")
            .select(F.col("vec_id").cast(kind).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label", every: int = 100) -> tuple[int, int]:
    """(links found, links there are) of the queries: ids divisible by ``every``, each against all rows."""
    rows = stage(usable(vectors, id_col, vec_col, label_col), "audit-rows")
    queries = rows.filter(F.col("id") % every == 0).select("cell", F.col("id").alias("query"), F.col("vec").alias("qvec"))

    width = shuffle_width(vectors.sparkSession)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(width)).cast("int"))
    spread = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "truth": pa.array([], pa.int64())})
        if right.num_rows:
            hit = unit(left["qvec"].to_pylist()) @ unit(right["vec"].to_pylist()).T >= threshold
            same = np.asarray(left["query"])[:, None] == np.asarray(right["id"])[None, :]
            total = (hit & ~same).sum(1)
        else:
            total = np.zeros(left.num_rows, np.int64)
        return pa.table({"query": left["query"], "truth": pa.array(total, pa.int64())})

    truth = (spread.groupBy("cell", "block").cogroup(blocks.groupBy("cell", "block"))
             .applyInArrow(block, "query long, truth long").groupBy("query").agg(F.sum("truth").alias("truth")))
    both = truth.join(result.select(F.col("vec_id").alias("query"), "n_links"), "query")
    r = both.agg(F.sum(F.least("n_links", "truth")).alias("found"), F.sum("truth").alias("truth")).first()
    return int(r.found or 0), int(r.truth or 0)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
