"""Near duplicates by SimHash fingerprints, compared bit-sliced (operator 13).

Fingerprints that differ in few bits agree on one of a few pieces of their bits. All that agree on
a piece meet in a task, which holds them as bit planes: word w of plane i has bit i of 64 of them.
One query's bit against a plane gives 64 differences at once; carry-save adders count them, and a
block of 64 is abandoned once all its counts are beyond the radius. A piece that too many share
is cut into pieces of the bits that are left, so every task's work is bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.similarity import _labels

BITS = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42, most: int = 65_536) -> int:
    """Bit i is one if it is set in over half of the hashes of all ``k``-word shingles; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[k - 1 :] - 1
    starts = np.concatenate([[0], ends[: len(words) - k]])
    n, counts = len(starts), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, most):
        spans = zip(starts[at : at + most].tolist(), last[at : at + most].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)): word w of plane i holds bit i of the fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _add(a, b, c):
    """A full adder in every bit: the sum, and the carry that counts twice."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


class Counter:
    """Distances of all (query, block) cells so far: three bits of a count in every bit, and what went beyond seven."""

    def __init__(self, shape):
        self.ones, self.twos, self.fours, self.over = (np.zeros(shape, dtype=np.uint64) for _ in range(4))

    def add(self, d: list[np.ndarray]) -> None:
        """Seven planes of differences."""
        s1, c1 = _add(d[0], d[1], d[2])
        s2, c2 = _add(d[3], d[4], d[5])
        one, c3 = _add(s1, s2, d[6])
        two, four = _add(c1, c2, c3)
        carry = self.ones & one
        self.ones ^= one
        self.twos, up = _add(self.twos, two, carry)
        self.fours, up = _add(self.fours, four, up)
        self.over |= up

    def beyond(self, radius: int) -> np.ndarray:
        """In every bit: is the count above ``radius``, at most 7?"""
        above, same = self.over.copy(), ~self.over
        for bits, weight in ((self.fours, 4), (self.twos, 2), (self.ones, 1)):
            if radius & weight:
                same &= bits
            else:
                above |= same & bits
                same &= ~bits
        return above

    def take(self, live: np.ndarray) -> None:
        for name in ("ones", "twos", "fours", "over"):
            setattr(self, name, getattr(self, name)[live])


def links(fps: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of fingerprints that differ in ``radius`` bits or less, at most 7."""
    if radius > 7:
        raise ValueError("counts hold a radius of 7 at most")
    plane = planes(fps)
    varying = np.flatnonzero((plane.max(axis=1) != 0) & (plane.min(axis=1) != _ALL))
    for at in range(0, len(fps), block):
        q = fps[at : at + block]
        # cells of queries and blocks of 64, from the block that holds the query on
        qi, w = np.nonzero((np.arange(len(q)) + at)[:, None] // 64 <= np.arange(plane.shape[1])[None, :])
        count = Counter(len(qi))
        zero = np.zeros(len(qi), dtype=np.uint64)
        for first in range(0, len(varying), 7):
            some = varying[first : first + 7]
            d = [plane[i][w] ^ (np.uint64(0) - ((q[qi] >> np.uint64(i)) & np.uint64(1))) for i in some]
            count.add(d + [zero[: len(qi)]] * (7 - len(d)))
            live = count.beyond(radius) != _ALL
            if not live.all():
                qi, w = qi[live], w[live]
                count.take(live)
            if not len(qi):
                break
        if len(qi):
            near = np.unpackbits((~count.beyond(radius)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(near)
            i, j = qi[cell] + at, 64 * w[cell] + bit
            take = (i < j) & (j < len(fps))
            yield i[take], j[take]


def _spread(members: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each member is connected with."""
    root = np.arange(members)
    for i, j in found:
        while True:
            a, b = root[i], root[j]
            if np.array_equal(a, b):
                break
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


def pieces(bits: list[int], n: int) -> list[list[int]]:
    """The bit numbers, dealt in order to ``n`` pieces of nearly equal length."""
    return [p.tolist() for p in np.array_split(np.array(bits, dtype=np.int64), n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << i for i in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _meetings(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """(mask, value, fp): fingerprints that agree on the bits of a mask; all that differ in ``radius`` bits or less meet.

    A meeting of more than ``most`` is cut further by the bits that its mask leaves, until these are
    no more than the radius.
    """
    spark = fps.sparkSession
    done, todo, masks = [], fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0]
    while masks:
        cuts = [(_signed(m), _signed(m | _mask(p))) for m in masks for p in pieces([i for i in range(BITS) if not m >> i & 1], radius + 1)]
        table = F.broadcast(spark.createDataFrame(cuts, "mask long, next long"))  # follows the bits and the radius, not the rows
        cut = todo.join(table, "mask").select(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("value"), "fp")
        if done:  # two meetings can be cut to the same bits
            cut = store.materialize(cut.distinct(), "simhash-meetings")
        met = store.materialize(cut.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        hot = (F.col("n") > most) & (F.bit_count("mask") < BITS - radius)
        done.append(cut.join(met.where(~hot).select("mask", "value"), ["mask", "value"], "left_semi"))
        masks = [r["mask"] & (1 << 64) - 1 for r in met.where(hot).select("mask").distinct().collect()]
        todo = cut.join(met.where(hot).select("mask", "value"), ["mask", "value"], "left_semi").select("mask", "fp")
    return reduce(DataFrame.unionByName, done)


def near(fps: DataFrame, radius: int = 4, most: int = 2048) -> DataFrame:
    """(a, b): edges that connect all fingerprints, a column ``fp`` of distinct longs, that links connect."""
    met = _meetings(fps, radius, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def edges():
            members = np.array(held, dtype=np.int64)
            root = _spread(len(members), links(members.view(np.uint64), radius))
            take = np.flatnonzero(root != np.arange(len(members)))
            return pa.RecordBatch.from_arrays([pa.array(members[root[take]]), pa.array(members[take])], names=["a", "b"])

        for batch in batches:
            for mask, value, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (mask, value) != at:
                    if len(held) > 1:
                        yield edges()
                    at, held = (mask, value), []
                held.append(fp)
        if len(held) > 1:
            yield edges()

    dealt = met.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(store.tidy(run), "a long, b long").distinct()


def components(docs: DataFrame, k: int = 4, seed: int = 42, radius: int = 4, most: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, component_id of every row, for links of ``radius`` differing bits or less.

    A-Z become lower case; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``k`` words is
    one shingle. Null texts and texts without words have the fingerprint zero and are linked like
    any other. A component's id is its smallest doc_id; null ids take no part in that. Repeated
    rows are returned each; other columns are ignored; very long texts are hashed whole, a stretch
    at a time; an empty table stays empty.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, k, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = store.materialize(base.mapInArrow(store.tidy(scan), "doc_id long, fp long"), "simhash-documents", batch=200)
    groups = store.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-groups")
    edges = store.materialize(near(groups.select("fp"), radius, most), "simhash-edges")
    named = groups.withColumn("label", F.col("fp"))
    if not edges.isEmpty():
        labels = _labels(edges).withColumnRenamed("node", "fp")
        named = groups.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = store.materialize(named.join(least, "label").select("fp", "n", "component_id"), "simhash-components")
    store.discard(groups, edges)
    # fingerprints that many rows share, at most 10,000 of them, are met without a shuffle
    common = F.col("n") * 10_000 > max(1, rows.count())
    much = named.where(common).select("fp", F.col("component_id").alias("of_common"), F.lit(True).alias("common"))
    d = rows.join(F.broadcast(much), "fp", "left")
    few = d.where("common IS NULL").select("doc_id", "fp").join(named.where(~common).select("fp", "component_id"), "fp")
    d = d.where("common").select("doc_id", "fp", F.col("of_common").alias("component_id")).unionByName(few.select("doc_id", "fp", "component_id"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
