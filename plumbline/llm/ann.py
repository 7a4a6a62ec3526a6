"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 8).

The tree is fitted on a bounded sample; every vector is indexed in a leaf. A query walks the
tree through a priority queue and visits leaves best first; how many is widened until the
recall of a sample of the queries, held out from the fit, reaches the target. A query whose
leaves hold too few vectors goes on to further leaves.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store


class Tree:
    """Nodes of a k-means tree over unit vectors: ``centres[i]`` of the children ``children[i]``.

    A child is a node number, or -1 - leaf. Leaves are numbered from 0.
    """

    def __init__(self, sample: np.ndarray, leaf_size: int, branching: int = 8, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.n_leaves = 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(1, leaf_size), branching)

    def _grow(self, x: np.ndarray, leaf_size: int, k: int) -> int:
        if len(x) > leaf_size:
            centres, part = self._kmeans(x, min(k, -(-len(x) // leaf_size)))
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append(np.zeros(len(centres), dtype=np.int64))
                for i in range(len(centres)):
                    self.children[node][i] = self._grow(x[part == i], leaf_size, k)
                return node
        self.n_leaves += 1
        return -self.n_leaves

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        centres = x[self._rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            part = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, part, x)
            norm = np.linalg.norm(sums, axis=1)
            live = norm > 0
            centres = sums[live] / norm[live, None]
        part = np.argmax(x @ centres.T, axis=1)
        used, part = np.unique(part, return_inverse=True)
        return centres[used], part

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                part = np.argmax(x[rows] @ self.centres[node].T, axis=1)
                todo += [(int(c), rows[part == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, leaves: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first walk from the root.

        With the leaves' ``sizes``, as many more as it takes until they hold ``least`` entries.
        """
        heap, found = [(0.0, 0, self.root)], []
        order = held = 0
        while heap and (len(found) < leaves or sizes is not None and held < least):
            _, _, node = heapq.heappop(heap)
            if node < 0:
                found.append(-1 - node)
                held += 0 if sizes is None else int(sizes[-1 - node])
                continue
            for near, child in zip(self.centres[node] @ q, self.children[node]):
                order += 1
                heapq.heappush(heap, (-float(near), order, int(child)))
        return found


def calibrate(tree: Tree, sample: np.ndarray, q: np.ndarray, k: int, target: float) -> int:
    """Fewest leaf visits, within a tenth, at which queries find ``target`` of their k nearest in the sample, themselves not."""
    near = q @ sample.T
    near[near > 1 - 1e-12] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1 or not len(q):
        return tree.n_leaves
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    leaf = tree.leaf_of(sample)
    rank = np.full((len(q), tree.n_leaves), tree.n_leaves)
    for i, x in enumerate(q):
        rank[i, tree.visit(x, tree.n_leaves)] = np.arange(tree.n_leaves)
    needed = np.take_along_axis(rank, leaf[true], axis=1)
    m = 1
    while m < tree.n_leaves and (needed < m).mean() < target:
        m = max(m + 1, int(m * 1.1))
    return min(m, tree.n_leaves)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` floats, and which rows take part: right length, all finite, not zero."""
    ok = np.zeros(len(column), dtype=bool)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(right), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        wide = x.astype(np.float64)
        fine = np.isfinite(wide).all(axis=1) & (np.einsum("ij,ij->i", wide, wide) > 0)
    ok[right[fine]] = True
    return x[fine], ok


def nearest(
    vectors: DataFrame,
    queries_every: int = 50,
    k: int = 5,
    target_recall: float = 0.97,
    max_fit: int = 20_000,
    max_calibrate: int = 512,
    leaf_rows: int = 256,
    block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that were found for each query.

    Queries are rows whose id is divisible by ``queries_every``. Nulls, zero vectors, null or
    non-finite components, null ids and lengths other than the most common one take no part.
    Repeated rows count once. Equal vectors are indexed once, with their k + 1 smallest ids,
    which is all that an answer can need; so a vector that a third of the rows share is one
    entry. The tree is fitted on ``max_fit`` distinct vectors at most, those with the smallest
    hashes, less the ``max_calibrate`` queries at most that it is calibrated on; leaves hold ``leaf_rows`` rows on average, more once there are more than
    ``max_fit * leaf_rows / 8`` rows, and are worked on in blocks. An empty table stays empty.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], empty)
    dim, kind = dims["dim"], np.float64 if "double" in dict(vectors.dtypes)[embedding] else np.float32

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once in a batch, with its smallest ids and the ids that are queries."""
        for batch in batches:
            x, ok = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[ok]
            found: dict[bytes, list[int]] = {}
            for i, v in zip(ids.tolist(), np.ascontiguousarray(x, dtype=kind)):
                found.setdefault(v.tobytes(), []).append(i)
            if found:
                sets = [sorted(set(v)) for v in found.values()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.keys(), pa.binary()),
                    pa.array([s[: k + 1] for s in sets], pa.list_(pa.int64())),
                    pa.array([[i for i in s if i % queries_every == 0] for s in sets], pa.list_(pa.int64())),
                ], names=["vec", "ids", "asks"])

    cleaned = store.materialize(rows.mapInArrow(clean, "vec binary, ids array<long>, asks array<long>"), "ann-clean")
    distinct = cleaned.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    asked = cleaned.select("vec", F.explode("asks").alias("query_id")).distinct()
    distinct = store.materialize(distinct, "ann-distinct")
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], empty)
    picked = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(max_fit).collect()
    asking = asked.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(max_calibrate).collect()
    held_out = {bytes(r.vec) for r in asking}
    fitted = [v for v in (bytes(r.vec) for r in picked) if v not in held_out] or sorted(held_out)
    matrix = lambda vs: _unit(np.frombuffer(b"".join(vs), dtype=kind).reshape(-1, dim))
    sample = matrix(fitted)
    leaves = int(np.clip(n // leaf_rows, 1, max(1, len(sample) // 8)))
    tree = Tree(sample, -(-len(sample) // leaves))
    visits = calibrate(tree, sample, matrix(sorted(held_out)) if held_out else sample[:0], k, target_recall)
    shared = spark.sparkContext.broadcast(pickle.dumps(tree))  # max_fit / 4 centres at most

    def assign(batches):
        grown = pickle.loads(shared.value)
        for batch in batches:
            x = _unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grown.leaf_of(x))], names=["vec", "ids", "leaf"])

    index = store.materialize(distinct.mapInArrow(assign, "vec binary, ids array<long>, leaf long"), "ann-index")
    sizes = np.zeros(tree.n_leaves, dtype=np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():  # max_fit / 8 rows at most
        sizes[r["leaf"]] = r["n"]

    def route(batches):
        grown = pickle.loads(shared.value)
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            for at in range(0, len(vecs), 512):
                part = vecs[at : at + 512]
                x = _unit(np.frombuffer(b"".join(part), dtype=kind).reshape(-1, dim))
                to = [grown.visit(q, visits, sizes, k + 1) for q in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v for v, t in zip(part, to) for _ in t], pa.binary()), pa.array([i for t in to for i in t], pa.int64())], names=["vec", "leaf"]
                )

    probes = store.materialize(asked.select("vec").distinct().mapInArrow(route, "vec binary, leaf long"), "ann-probes")
    # leaves and their queries are cut into blocks, so that no leaf is one task's burden
    parts = index.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("long").alias("n_in"))
    askers = probes.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("long").alias("n_q"))
    blocks = F.broadcast(parts.join(askers, "leaf"))  # one row a leaf, max_fit / 8 at most
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = probes.join(blocks, "leaf").withColumn("q", F.pmod(F.xxhash64("vec"), F.col("n_q"))).withColumn("b", upto("n_in")).select("leaf", "b", "q", "vec")
    right = index.join(blocks, "leaf").withColumn("b", F.pmod(F.xxhash64("vec"), F.col("n_in"))).withColumn("q", upto("n_q")).select("leaf", "b", "q", "vec", "ids")

    def compare(asks: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(entries):
            x = np.frombuffer(b"".join(entries["vec"]), dtype=kind).reshape(-1, dim).astype(np.float64)
            x_norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            ids = entries["ids"].tolist()
            first = np.array([i[0] for i in ids])
            for v in asks["vec"]:
                q = np.frombuffer(v, dtype=kind).astype(np.float64)
                s = np.einsum("ij,j->i", x, q) / (x_norm * np.sqrt(np.einsum("i,i->", q, q)))
                top = np.arange(len(s)) if len(s) <= k + 1 else np.flatnonzero(s >= np.partition(s, -k - 1)[-k - 1])
                top = top[np.lexsort((first[top], -s[top]))]
                best = sorted((-s[j], i) for j in top for i in ids[j])[: k + 1]
                out.append((v, [a for a, _ in best], [i for _, i in best]))
        return pd.DataFrame(out, columns=["vec", "far", "ids"])

    # a row for each query and block, with its best there
    found = left.groupBy("leaf", "b", "q").cogroup(right.groupBy("leaf", "b", "q")).applyInPandas(compare, "vec binary, far array<double>, ids array<long>")
    pairs = F.zip_with("far", "ids", lambda a, i: F.struct(a.alias("far"), i.alias("vec_id")))
    best = found.select("vec", pairs.alias("part")).groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("part"))), 1, k + 1).alias("best"))
    hits = asked.join(best, "vec").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    d = hits.select("query_id", F.posexplode("best").alias("at", "hit"))
    return d.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
