"""Exact k-means over whole numbers with Drake's adaptive bounds (operator 11).

Every vector keeps its centroid with an upper bound of the distance, the next few centroids with
a lower bound each, and one lower bound for all that remain. When centroids move, bounds move with
them; distances are worked out again only for vectors whose order the bounds can't certify, and
only to as many centroids as it takes. A round is one pass without a shuffle: a task writes its
vectors' new state together with what its changes add to the sums of the clusters, so a lost
executor costs its tasks and nothing is counted twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

#: Components are whole numbers up to this size, so that 64 squared differences fit in a long.
LARGEST = 1 << 27
#: Up to this size they are exact in doubles, too, and products go through BLAS.
_DOUBLE = 1 << 22
#: Bounds give way by so much for the rounding of square roots and sums.
_SLACK = 1e-12
_STATE = "vec_id long, vec binary, cluster int, upper double, near binary, low binary, rest double, distance long"
_SUMS = "moved array<long>, n long, used int, inertia decimal(38,0)"


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors that take part, and which of the rows these are."""
    ok = np.zeros(len(column), dtype=bool)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(len(right), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x.astype(np.float64))
        fine = (np.abs(x) <= LARGEST).all(axis=1)  # NaN compares as false
    ok[right[fine]] = True
    return x[fine].astype(np.int32), ok


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _DOUBLE else np.int64
    x, c = x.astype(kind), c.astype(kind)
    d = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
    return d.astype(np.int64)


def some_distances(x: np.ndarray, c: np.ndarray, which: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Exact squared distances of each row to the centroids ``which`` names for it."""
    out = np.empty(which.shape, dtype=np.int64)
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        diff = x[part, None, :].astype(np.int64) - c[which[part]]
        out[part] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


class Bounds:
    """The state of a batch of vectors: ``cluster``, ``upper``, ``near`` with ``low``, ``rest``."""

    def __init__(self, cluster, upper, near, low, rest):
        self.cluster, self.upper, self.near, self.low, self.rest = cluster, upper, near, low, rest

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """From the distances to all centroids; of equal distances the smaller number is nearer."""
        d = distances(x, c)
        order = np.argsort(d, axis=1, kind="stable").astype(np.int32)
        far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        rest = far[:, b + 1] * (1 - _SLACK) if b + 1 < len(c) else np.full(len(x), np.inf)
        return cls(order[:, 0].copy(), far[:, 0] * (1 + _SLACK), order[:, 1 : b + 1].copy(), far[:, 1 : b + 1] * (1 - _SLACK), rest)

    def narrowed(self, b: int) -> Bounds:
        """With ``b`` single bounds; those that go join the remainder's."""
        if b < self.low.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(axis=1))
            self.near, self.low = self.near[:, :b].copy(), self.low[:, :b].copy()
        return self

    def moved(self, x: np.ndarray, c: np.ndarray, shift: np.ndarray) -> int:
        """Nearest centroids after these moved by ``shift``; how many bounds a vector needed at most."""
        b = self.low.shape[1]
        self.upper = (self.upper + shift[self.cluster]) * (1 + _SLACK)
        by = shift[self.near]
        self.low = self.low - by - _SLACK * (np.abs(self.low) + by)
        self.rest = self.rest - shift.max() - _SLACK * (np.where(np.isinf(self.rest), 0, np.abs(self.rest)) + shift.max())
        # from[i]: a bound for everything from the i-th nearest on
        beyond = np.minimum.accumulate(np.column_stack([self.low, self.rest])[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.upper >= beyond[:, 0])
        if not len(open_):
            return 0
        d = some_distances(x[open_], c, self.cluster[open_, None])[:, 0]
        self.upper[open_] = np.sqrt(d.astype(np.float64)) * (1 + _SLACK)
        certain = self.upper[open_, None] < beyond[open_]
        need = np.where(certain.any(axis=1), certain.argmax(axis=1), b + 1)
        for i in range(1, b + 1):
            pick = need == i
            rows = open_[pick]
            if len(rows):
                self._reorder(rows, x[rows], c, d[pick], i)
        rows = open_[need == b + 1]
        if len(rows):
            new = Bounds.scanned(x[rows], c, b)
            for name in ("cluster", "upper", "near", "low", "rest"):
                getattr(self, name)[rows] = getattr(new, name)
        return int(min(need.max(), b))

    def _reorder(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray, d: np.ndarray, i: int) -> None:
        """The first ``i`` of the single bounds are worked out again; all others are farther for certain."""
        which = np.column_stack([self.cluster[rows], self.near[rows, :i]])
        d = np.column_stack([d, some_distances(x, c, which[:, 1:])])
        order = np.lexsort((which, d), axis=1)
        which = np.take_along_axis(which, order, axis=1)
        far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        self.cluster[rows], self.near[rows, :i] = which[:, 0], which[:, 1:]
        self.upper[rows], self.low[rows, :i] = far[:, 0] * (1 + _SLACK), far[:, 1:] * (1 - _SLACK)


def _stack(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors of ``dim`` finite components become floor(``scale`` * x). Centroids start as the ``k``
    vectors with the smallest sha256 of ``<seed>:<vec_id>`` (ties: smaller components), fewer if
    there are fewer. After ``rounds`` rounds of assigning (ties: smaller number) and replacing each
    non-empty centroid by the floor of its mean, vectors are assigned once more.

    Null vectors, other lengths, null or non-finite components take no part, nor do components
    beyond 2**27 once scaled, whose distance would not fit in a long. A null id takes part but
    never starts a centroid, unless all ids are null. Repeated rows count each; other columns are
    ignored; an empty table stays empty. A sum of distances beyond a long is null. The driver holds
    k centroids and k sums a round.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.size("embedding") == dim)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = whole_numbers(batch.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), _blobs(x)], names=["vec_id", "vec"])

    kept = store.materialize(rows.mapInArrow(store.tidy(clean), "vec_id long, vec binary"), "clusters-vectors", batch=10_000)
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(lot.asc_nulls_last(), "vec").limit(k).collect()
    if not first:
        store.discard(kept)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.stack([np.frombuffer(r["vec"], dtype=np.int32) for r in first]).astype(np.int64)
    k = len(c)
    least = min(-(-k // 8), k - 1)
    b, held, shift = min(-(-k // 4), k - 1), -1, np.zeros(k)
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    state = kept
    for turn in range(rounds + 1):
        step = store.materialize(state.mapInArrow(store.tidy(_pass(c, shift, held, b, dim, turn == rounds)), f"{_STATE}, {_SUMS}"), "clusters-state", batch=10_000)
        store.discard(state)
        state = step
        # k rows, however many vectors
        changes = step.where("vec IS NULL").groupBy("cluster").agg(
            F.sum("n").alias("n"), F.max("used").alias("used"), F.sum("inertia").alias("inertia"), *[F.sum(F.col("moved")[i]).alias(f"s{i}") for i in range(dim)]
        )
        changes = changes.collect()
        if turn == rounds:
            break
        for r in changes:
            if r["n"] is not None:
                counts[r["cluster"]] += r["n"]
                sums[r["cluster"]] = [s + r[f"s{i}"] for i, s in enumerate(sums[r["cluster"]])]
        new = np.array([[s // n for s in t] if n else old.tolist() for t, n, old in zip(sums, counts, c)], dtype=np.int64)
        shift = np.sqrt(np.einsum("ij,ij->i", new - c, new - c).astype(np.float64)) * (1 + _SLACK)
        c, held = new, b
        if turn:
            b = min(b, max([least, *(r["used"] for r in changes if r["used"] is not None)]))

    total = {r["cluster"]: int(r["inertia"]) for r in changes if r["inertia"] is not None}
    fits = lambda n: n if n < 1 << 63 else None
    names = [(j, fits(total[j]), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(total)]
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = state.where("vec IS NOT NULL").select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(total.values()))).cast("long").alias("inertia"), "centroid_sha256")


def _pass(c: np.ndarray, shift: np.ndarray, held: int, b: int, dim: int, last: bool):
    """A round of a task: the new state of its vectors, then a row a cluster of what changed.

    ``held`` is how many single bounds the state has (-1: none yet), ``b`` how many it keeps.
    """
    k = len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, n, used = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64), 0
        inertia, changed = [0] * k, np.zeros(k, dtype=bool)
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if held >= 0:
                real = pa.compute.is_valid(col["vec"])
                col = {name: a.filter(real) for name, a in col.items()}
            x = _stack(col["vec"], np.int32, dim)
            if not len(x):
                continue
            if held < 0:
                state, old = Bounds.scanned(x, c, b), None
            else:
                old = col["cluster"].to_numpy()
                state = Bounds(old.copy(), col["upper"].to_numpy(), _stack(col["near"], np.int32, held), _stack(col["low"], np.float64, held), col["rest"].to_numpy())
                state = Bounds(state.cluster, state.upper.copy(), state.near.copy(), state.low.copy(), state.rest.copy()).narrowed(b)
                used = max(used, state.moved(x, c, shift))
            other = np.ones(len(x), dtype=bool) if old is None else state.cluster != old
            np.add.at(moved, state.cluster[other], x[other])
            np.add.at(n, state.cluster[other], 1)
            changed[state.cluster[other]] = True
            if old is not None:
                np.subtract.at(moved, old[other], x[other])
                np.subtract.at(n, old[other], 1)
                changed[old[other]] = True
            distance = pa.nulls(len(x), pa.int64())
            if last:
                d = some_distances(x, c, state.cluster[:, None])[:, 0]
                distance = pa.array(d)
                for j in np.unique(state.cluster):
                    inertia[j] += sum(d[state.cluster == j].tolist())
                    changed[j] = True
            yield _rows(col["vec_id"], col["vec"], state, distance)
        js = np.flatnonzero(changed)
        if len(js) or used:
            js = js if len(js) else np.array([0])
            yield _rows_of_sums(js, moved, n, used, inertia)

    return run


_NAMES = [f.split()[0] for f in f"{_STATE}, moved, n, used, inertia".split(", ")]


def _rows(vec_id: pa.Array, vec: pa.Array, s: Bounds, distance: pa.Array) -> pa.RecordBatch:
    m = len(vec)
    return pa.RecordBatch.from_arrays([
        vec_id, vec, pa.array(s.cluster, pa.int32()), pa.array(s.upper), _blobs(s.near.astype(np.int32)), _blobs(s.low), pa.array(s.rest), distance,
        pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.decimal128(38, 0)),
    ], names=_NAMES)


def _rows_of_sums(js: np.ndarray, moved: np.ndarray, n: np.ndarray, used: int, inertia: list[int]) -> pa.RecordBatch:
    m = len(js)
    return pa.RecordBatch.from_arrays([
        pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(js, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()),
        pa.array(moved[js].tolist(), pa.list_(pa.int64())), pa.array(n[js]), pa.array([used] * m, pa.int32()), pa.array([Decimal(inertia[j]) for j in js], pa.decimal128(38, 0)),
    ], names=_NAMES)
