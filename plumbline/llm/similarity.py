"""Exact n-gram Jaccard self-join by a token-group matrix (operator 6).

Similar documents are partitioned into groups; a group keeps its token union; a query
document's overlap with the union bounds its similarity to every member, and only groups
whose bound reaches the threshold are opened. The matrix is worked on at two grains:

1. Coarse, one group against the rest of the corpus: a sample of the token space says how
   many of a document's tokens any other document has. Those with too few are done.
2. Fine, among the others: documents with the same smallest token form groups, whose links
   are found exactly within; connected members stay one group. Groups that share a token
   of their prefixes are compared, union first, until no two groups can be linked.

Links are never listed in full: two connected groups need one link. Exact copies are one
set from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

#: Parts of the token space at least: a task holds one whole, so that its memory does not hang on the number of shuffle partitions.
_RANGES = 1024

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes; words are hashed once and kept."""

    def __init__(self, k: int, max_cached: int = 200_000):
        self.k, self.max_cached, self.cache = k, max_cached, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(cache) > self.max_cached:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        h = self._hashes(words)
        n = len(h) - self.k + 1
        x = np.zeros(n, dtype=np.uint64)
        for i in range(self.k):
            x = (x ^ h[i : i + n]) * _MIX[0]
            x ^= x >> np.uint64(29)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return np.unique(x ^ (x >> np.uint64(31)))


class Threshold:
    """Jaccard similarity of ``num / den`` or more, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def missing(self, n):
        """How many tokens of a set of n a linked set may lack."""
        return n * (self.den - self.num) // self.den

    def linked(self, shared, n, m):
        return self.den * shared >= self.num * (n + m - shared)


def by_key(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` on the rows of each key, as dicts; groups must be of bounded size. Cheaper than a call into pandas for each."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, out = [], None, []

        def flush():
            nonlocal out
            done = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
            out = []
            return done

        for batch in batches:
            for row in (r for at_row in range(0, batch.num_rows, 32) for r in batch.slice(at_row, 32).to_pylist()):
                key = tuple(row[k] for k in keys)
                if group and key != at:
                    out.extend(fn(group))
                    group = []
                    if len(out) > 2000:
                        yield flush()
                at = key
                group.append(row)
        if group:
            out.extend(fn(group))
        if out:
            yield flush()

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(store.tidy(run), schema)


# ---- the coarse matrix: each document against the rest of the corpus ---------------------

_SCAN = "rid long, doc_id long, n long, fp binary, sampled long, local long, block long, idx long, range long, blob binary"


def _pack(tokens: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted 32-bit tokens by the byte planes of their steps, and whole numbers of theirs by their byte planes."""
    steps = np.diff(tokens, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate([c.view(np.uint8).reshape(-1, c.itemsize).T.ravel() for c in (steps, *(np.ascontiguousarray(c) for c in columns))])
    return len(tokens).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    sizes = [4, *(np.dtype(k).itemsize for k in kinds)]
    planes = np.frombuffer(pa.decompress(blob[4:], n * sum(sizes), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for size, kind in zip(sizes, ("<u4", *kinds)):
        out.append(np.ascontiguousarray(planes[at : at + size * n].reshape(size, n).T).view(kind).ravel())
        at += size * n
    return [np.cumsum(out[0], dtype=np.uint32), *out[1:]]


def _scan(docs: DataFrame, k: int, share: float, n_ranges: int, max_tokens: int = 750_000) -> DataFrame:
    """A row for each document, and blocks of sampled tokens by range of the token space.

    A token that two different sets of a block have is shared whatever other blocks hold, so
    it is sent once, for no document, and counted here; other tokens are sent with theirs.
    """
    limit = _limit(share)
    width = -(-int(limit) // n_ranges)
    shift = np.uint64(max(0, width.bit_length() - 32))
    names = [x.strip().split(" ")[0] for x in _SCAN.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.strip().split(" ")[1]] for x in _SCAN.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        block = TaskContext.get().partitionId() << 24
        rows, sets, idx, size = [], [], {}, 0

        def flush():
            nonlocal rows, sets, idx, size, block
            tok = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(tok, kind="stable")
            tok, doc = tok[order], doc[order]
            new = np.ones(len(tok), dtype=bool)
            new[1:] = tok[1:] != tok[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(tok))) > 1
            local = np.bincount(doc[np.repeat(many, np.diff(np.append(first, len(tok))))], minlength=len(sets))
            tok, doc = tok[first], np.where(many, -1, doc[first])
            part = (tok // np.uint64(width)).astype(np.int64)
            small = ((tok - part.astype(np.uint64) * np.uint64(width)) >> shift).astype(np.uint32)
            cols: list[list] = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]
            cols[5] = [int(local[i]) if i is not None else 0 for i in cols[5]]
            ends = np.searchsorted(part, np.arange(n_ranges + 1))
            blobs = [(r, _pack(small[a:b], doc[a:b].astype("<i4"))) for r, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            n, m = len(rows), len(blobs)
            idx_col = [r[5] for r in rows]
            data = [c + [None] * m for c in cols[:5]] + [cols[5] + [None] * m, [block] * (n + m), idx_col + [None] * m, [None] * n + [b[0] for b in blobs], [None] * n + [b[1] for b in blobs]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types)], names=names)
            rows, sets, idx, size, block = [], [], {}, 0, block + 1
            return out

        for batch in batches:
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text)
                if not len(s):
                    rows.append((rid, doc_id, 0, None, 0, None))
                    continue
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                some = s[: np.searchsorted(s, limit)]
                if fp not in idx:
                    idx[fp] = len(sets)
                    sets.append(some)
                    size += len(some)
                rows.append((rid, doc_id, len(s), fp, len(some), idx[fp]))
                if size > max_tokens or len(rows) > 200_000:
                    yield flush()
        if rows:
            yield flush()

    return store.materialize(docs.mapInArrow(store.tidy(run), _SCAN), "jaccard-scan")


def _support(scan: DataFrame) -> DataFrame:
    """(block, idx, more): how many of a document's tokens, not shared in its own block, other blocks have."""

    def counted(block: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each block: its documents and their counts."""
        names, at = np.unique(block, return_inverse=True)
        pairs, n = np.unique(at << 32 | doc, return_counts=True)
        ends = np.searchsorted(pairs >> 32, np.arange(len(names) + 1))
        for name, a, b in zip(names.tolist(), ends, ends[1:]):
            docs = (pairs[a:b] & 0xFFFFFFFF).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([docs], pa.binary()), pa.array([n[a:b].astype("<i4").tobytes()], pa.binary())], names=["block", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found, size = None, [], [], 0

        def shared():
            tok = np.concatenate([h[0] for h in held])
            doc = np.concatenate([h[1] for h in held]).astype(np.int64)
            block = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
            order = np.argsort(tok, kind="stable")
            tok, doc, block = tok[order], doc[order], block[order]
            new = np.ones(len(tok), dtype=bool)
            new[1:] = tok[1:] != tok[:-1]
            n = np.diff(np.append(np.flatnonzero(new), len(tok)))
            take = np.repeat(n > 1, n) & (doc >= 0)
            return block[take], doc[take]

        for batch in batches:
            for r, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r != at:
                    found.append(shared())
                    size += len(found[-1][0])
                    held = []
                    if size > 500_000:
                        yield from counted(*map(np.concatenate, zip(*found)))
                        found, size = [], 0
                at = r
                held.append((*_unpack(blob, "<i4"), block))
        if held:
            found.append(shared())
        if found:
            yield from counted(*map(np.concatenate, zip(*found)))

    def total(rows):
        docs = np.concatenate([np.frombuffer(r["docs"], dtype="<i4") for r in rows])
        counts = np.bincount(docs, np.concatenate([np.frombuffer(r["counts"], dtype="<i4") for r in rows]))
        for i in np.flatnonzero(counts):
            yield rows[0]["block"], int(i), int(counts[i])

    n = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blobs = scan.where("range IS NOT NULL").select("range", "block", "blob").repartition(n, "range").sortWithinPartitions("range")
    return by_key(blobs.mapInArrow(store.tidy(run), "block long, docs binary, counts binary"), ["block"], total, "block long, idx long, more long")


# ---- the fine matrix: groups of similar documents ----------------------------------------

#: A group: its members' ids, set sizes, sketches (sampled tokens, cut to 32 bits) and sets, and their token union if they are several.
_GROUP = "root long, rids array<long>, ns array<long>, sketches array<binary>, sets array<binary>, tokens binary"


def _set(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.uint64)


def _links_within(sets: list[np.ndarray], t: Threshold, columns: int = 16384) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j) of a bounded number of sets."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if t.linked(shared, *size):
            yield 0, 1
        return
    tok, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    shared = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for at in range(0, len(tok), columns):
        a, b = np.searchsorted(col, (at, at + columns))
        x = np.zeros((m, min(columns, len(tok) - at)), dtype=np.float32)
        x[row[a:b], col[a:b] - at] = 1
        shared += x @ x.T
    shared = shared.astype(np.int64)
    yield from zip(*np.nonzero(np.triu(t.linked(shared, size[:, None], size[None, :]), 1)))


def _parts(m: int, links: Iterator[tuple[int, int]]) -> list[list[int]]:
    parent = list(range(m))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[top(i)] = top(j)
    out: dict[int, list[int]] = {}
    for i in range(m):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def _sketch(tokens: np.ndarray, share: float) -> bytes:
    """The sampled tokens' upper halves; two that fall together are both kept, so that overlap is never too small."""
    return (tokens[: np.searchsorted(tokens, _limit(share))] >> np.uint64(32)).astype("<u4").tobytes()


def _limit(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def _groups(sets: DataFrame, t: Threshold, share: float, most: int = 256, most_tokens: int = 1_000_000) -> DataFrame:
    """Groups of linked documents. Documents with one smallest token meet, in chunks of bounded size."""
    d = sets.withColumn("low", F.substring("set", 1, 8))
    chunks = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / most_tokens)).cast("long")
    hot = store.materialize(d.groupBy("low").agg(chunks.alias("chunks")).where("chunks > 1"), "jaccard-hot")  # one key in `most` rows at most
    d = d.join(store.small(hot), "low", "left").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.coalesce("chunks", F.lit(1).cast("long"))))

    def meet(rows):
        rows.sort(key=lambda r: r["rid"])
        got = [_set(r["set"]) for r in rows]
        for part in _parts(len(rows), _links_within(got, t) if len(rows) > 1 else iter(())):
            own = [got[i] for i in part]
            union = np.unique(np.concatenate(own)).tobytes() if len(part) > 1 else None
            yield rows[part[0]]["rid"], [rows[i]["rid"] for i in part], [len(s) for s in own], [_sketch(s, share) for s in own], [s.tobytes() for s in own], union

    return store.materialize(by_key(d.select("low", "chunk", "rid", "set"), ["low", "chunk"], meet, _GROUP), "jaccard-groups", batch=100)


def _may_link(a: dict, b: dict, t: Threshold) -> bool:
    """The bound by sketches: whether a document of the smaller group has enough sampled tokens in the other's union."""
    if len(a["ns"]) > len(b["ns"]):
        a, b = b, a
    low, high = min(b["ns"]), max(b["ns"])
    union = np.concatenate([np.frombuffer(x, dtype="<u4") for x in b["sketches"]])
    for n, q in zip(a["ns"], a["sketches"]):
        if high * t.den >= n * t.num and n * t.den >= low * t.num:
            q = np.frombuffer(q, dtype="<u4")
            if np.isin(q, union).sum() >= len(q) - t.missing(n):
                return True
    return False


def _any_link(a: dict, b: dict, t: Threshold) -> bool:
    """Whether two groups are linked: a document of the smaller one opens the other if its union bound allows it."""
    if len(a["sets"]) > len(b["sets"]):
        a, b = b, a
    members = [_set(s) for s in b["sets"]]
    union = _set(b["tokens"]) if b["tokens"] else members[0]
    for q in map(_set, a["sets"]):
        if len(np.intersect1d(q, union, assume_unique=True)) < len(q) - t.missing(len(q)):
            continue
        for s in members:
            if len(s) * t.den >= len(q) * t.num and len(q) * t.den >= len(s) * t.num and t.linked(len(np.intersect1d(q, s, assume_unique=True)), len(q), len(s)):
                return True
    return False


def _of_like_size(pairs: DataFrame, sizes: DataFrame, t: Threshold) -> DataFrame:
    """Those of the pairs (a, b) of groups of which some two members are near enough in size to be linked."""
    side = lambda x: store.small(sizes).select(F.col("root").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    return d.where((F.col("high_a") * t.den >= F.col("low_b") * t.num) & (F.col("high_b") * t.den >= F.col("low_a") * t.num)).select("a", "b")


def _linked_groups(pairs: DataFrame, groups: DataFrame, t: Threshold) -> DataFrame:
    """Those of the pairs (a, b) of groups that have a link: first by what sketches allow, then by the sets.

    While pairs are few they go to the groups, so that the groups' sets are dealt out once.
    """

    def step(pairs, columns, test, tag):
        met = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "root")
        some = groups.join(store.small(met), "root", "left_semi")
        side = lambda x: some.select(F.col("root").alias(x), F.struct(*columns).alias(f"of_{x}"))

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 16):
                    hits = [r for r in batch.slice(at, 16).to_pylist() if test(r["of_a"], r["of_b"], t)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in hits], pa.int64()) for x in ("a", "b")], names=["a", "b"])

        joined = side("a").join(store.small(pairs), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")
        return store.materialize(joined.mapInArrow(store.tidy(run), "a long, b long"), tag, batch=100)

    bounds = step(pairs, ["ns", "sketches"], _may_link, "jaccard-bounds")
    links = step(bounds, ["sets", "tokens"], _any_link, "jaccard-links")
    store.discard(bounds)
    return links


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each is connected with, by neighbours' labels and pointer jumping."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct()
    both = store.materialize(both, "labels-edges")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label"))
    labels = store.materialize(labels, "labels")
    while True:
        of = labels.select(F.col("node").alias("near"), F.col("label").alias("near_label"))
        best = both.join(of, "near").groupBy("node").agg(F.min("near_label").alias("low"))
        step = labels.join(best, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = store.materialize(step.join(jump, "label", "left").select("node", F.least("label", "far").alias("label"), "was"), "labels")
        done = step.where("label <> was").isEmpty()
        store.discard(labels)
        stored, labels = step.stored_at, step.select("node", "label")
        labels.stored_at = stored
        if done:
            store.discard(both)
            return labels


def _prefixes(groups: DataFrame, t: Threshold) -> DataFrame:
    """(token, root): the smallest tokens of each member, so many that linked members share one."""

    def run(batches):
        for batch in batches:
            for root, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.unique(np.concatenate([s[: t.missing(len(s)) + 1] for s in map(_set, sets)]))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.full(len(tokens), root))], names=["token", "root"])

    return groups.select("root", "sets").mapInArrow(store.tidy(run), "token long, root long")


def _pairs(rare: DataFrame, most: int = 4000, rows_a_task: int = 2000) -> DataFrame:
    """Groups with different labels that share a token of (token, root, label): rows (null, a, b).

    Tokens with the same first group meet in one task, a token at a time, because similar
    groups share many tokens and their pair is then made once; a first group of more than
    ``rows_a_task`` rows is dealt to several tasks by token. One with more than ``most`` pairs
    gives a family instead: rows (first group, member, null), to be compared in blocks.
    """
    lead = rare.groupBy("token").agg(F.min("root").alias("lead"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n")).where("l0 < l1")
    lead = store.materialize(lead.select("token", "lead", "n"), "jaccard-leads")
    parts = lead.groupBy("lead").agg(F.ceil(F.sum("n") / rows_a_task).cast("long").alias("parts")).where("parts > 1")
    parts = store.small(store.materialize(parts, "jaccard-parts"))

    def run(batches):
        at, token_at, here, seen, roots, full, out = None, None, [], set(), set(), False, []

        def meet():
            nonlocal full
            roots.update(r for r, _ in here)
            if full:
                return
            of: dict[int, list[int]] = {}
            for root, label in here:
                of.setdefault(label, []).append(root)
            if len(here) ** 2 - sum(len(r) ** 2 for r in of.values()) > 2 * most:
                full = True
            else:
                before: list[int] = []
                for own in of.values():
                    seen.update((min(a, b), max(a, b)) for a in own for b in before)
                    before += own
                full = len(seen) > most
            if full:
                seen.clear()

        def end():
            out.extend([(at[0], r, None) for r in roots] if full else [(None, a, b) for a, b in seen])

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["lead", "a", "b"])

        for batch in batches:
            for first, part, token, root, label in zip(*(c.to_pylist() for c in batch.columns)):
                if token != token_at or (first, part) != at:
                    meet()
                    token_at, here = token, []
                    if (first, part) != at:
                        end()
                        at, seen, roots, full = (first, part), set(), set(), False
                        if len(out) > 10_000:
                            yield rows()
                            out = []
                here.append((root, label))
        meet()
        end()
        if out:
            yield rows()

    n = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("token"), F.coalesce("parts", F.lit(1).cast("long")))
    dealt = rare.join(lead.drop("n"), "token").join(parts, "lead", "left").withColumn("part", part).repartition(n, "lead", "part").sortWithinPartitions("lead", "part", "token")
    return store.materialize(dealt.select("lead", "part", "token", "root", "label").mapInArrow(store.tidy(run), "lead long, a long, b long").distinct(), "jaccard-pairs")


def _linked_families(members: DataFrame, groups: DataFrame, roots: DataFrame, t: Threshold, size: int = 256) -> DataFrame:
    """Links between members (lead, root) of families, a block of two chunks of some ``size`` sets at a time.

    The members with a family's most common label are linked already and are not compared with
    each other: only the rest among themselves and with all. Within a block the token union of
    one chunk bounds each group of the other, and only groups whose bound allows a link are opened.
    """
    d = members.join(roots, "root").select("lead", "root", "label", "n_sets")
    most = d.groupBy("lead", "label").agg(F.sum("n_sets").alias("n")).groupBy("lead").agg(F.max(F.struct("n", F.negative("label").alias("label"))).alias("m"), F.sum("n").alias("n"))
    most = store.materialize(most.select("lead", F.negative("m.label").alias("main"), F.col("m.n").alias("n_main"), (F.col("n") - F.col("m.n")).alias("n_rest")), "jaccard-families")
    chunks = lambda c: F.greatest(F.ceil(F.col(c) / size).cast("long"), F.lit(1).cast("long"))
    d = d.join(store.small(most), "lead").withColumns({"c0": chunks("n_rest"), "c1": chunks("n_main"), "is_main": F.col("label") == F.col("main")})
    # chunks 0 to c0 - 1 hold the rest, those from c0 on the main label's members
    d = d.withColumn("i", F.pmod(F.xxhash64("root"), F.when(F.col("is_main"), F.col("c1")).otherwise(F.col("c0"))) + F.when(F.col("is_main"), F.col("c0")).otherwise(0))
    one = F.lit(1).cast("long")
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("is_main"), F.col("c0")).otherwise(F.col("c0") + F.col("c1")) - one)))
    d = d.select("lead", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "root", "label")
    some = store.small(store.materialize(members.select("root").distinct(), "jaccard-members"))
    d = d.join(groups.select("root", "sets").join(some, "root", "left_semi"), "root")

    def block(rows):
        rows.sort(key=lambda r: (r["i"], r["root"]))
        first = [r for r in rows if r["i"] == rows[0]["i"]]
        second = rows[len(first) :]
        if second:
            first, second = _opened(first, second, t), _opened(second, first, t)
        rows = first + second
        owner = [k for k, r in enumerate(rows) for _ in r["sets"]]
        sets = [_set(s) for r in rows for s in r["sets"]]
        if len(sets) < 2:
            return
        top = {r["label"]: r["label"] for r in rows}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for i, j in _links_within(sets, t, columns=max(512, min(16384, 4_000_000 // len(sets)))):
            a, b = rows[owner[i]], rows[owner[j]]
            x, y = find(a["label"]), find(b["label"])
            if x != y:
                top[y] = x
                yield min(a["root"], b["root"]), max(a["root"], b["root"])

    links = store.materialize(by_key(d, ["lead", "lo", "hi"], block, "a long, b long"), "jaccard-family-links", batch=100)
    store.discard(most)
    return links


def _opened(rows: list[dict], others: list[dict], t: Threshold) -> list[dict]:
    """Those of the groups of which some set has enough tokens in the other groups' union."""
    union = np.unique(np.concatenate([_set(s) for r in others for s in r["sets"]]))
    allows = lambda s: np.isin(s, union, assume_unique=True).sum() >= len(s) - t.missing(len(s))
    return [r for r in rows if any(allows(_set(s)) for s in r["sets"])]


_TOKENS = "block long, range long, blob binary, members binary"
#: A member's set size, distinct coarse tokens, group and label.
_MEMBER = ("<i8", "<i8", "<i8", "<i8")


def _rarest(groups: DataFrame, t: Threshold, n_ranges: int, max_tokens: int = 500_000) -> DataFrame:
    """(root, label, token): of each member of groups with labels, the rarest tokens, so many that linked members share one.

    Tokens are cut to a range and 32 bits, which can only join tokens, and go to their range's
    task packed. There those of one label are done; the others come back with the number of
    labels that have them, and each member keeps its rarest: frequent passages come last.
    """
    width = -(-(2**64) // n_ranges)
    shift = np.uint64(max(0, width.bit_length() - 32))
    names = [x.strip().split(" ")[0] for x in _TOKENS.split(",")]

    def coarse(s: np.ndarray) -> np.ndarray:
        part = s // np.uint64(width)
        return part << np.uint64(32) | (s - part * np.uint64(width)) >> shift

    def deal(batches):
        block, held, members, size = TaskContext.get().partitionId() << 24, [], [], 0

        def flush():
            nonlocal block, held, members, size
            tok = np.concatenate(held)
            idx = np.repeat(np.arange(len(held)), [len(h) for h in held])
            order = np.argsort(tok, kind="stable")
            tok, idx = tok[order], idx[order]
            label = np.array([m[3] for m in members], dtype="<i8")[idx]
            part, small = (tok >> np.uint64(32)).astype(np.int64), tok.astype(np.uint32)
            ends = np.searchsorted(part, np.arange(n_ranges + 1))
            blobs = [(r, _pack(small[a:b], idx[a:b].astype("<i4"), label[a:b])) for r, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            n = len(blobs)
            table = np.array(members, dtype="<i8").T.tobytes()
            out = pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1)), pa.array([*(b[0] for b in blobs), None], pa.int64()), pa.array([*(b[1] for b in blobs), None], pa.binary()), pa.array([None] * n + [table], pa.binary()),
            ], names=names)
            block, held, members, size = block + 1, [], [], 0
            return out

        for batch in batches:
            for root, label, sets in zip(*(c.to_pylist() for c in batch.columns)):
                for s in map(_set, sets):
                    c = np.unique(coarse(s))
                    held.append(c)
                    members.append((len(s), len(c), root, label))
                    size += len(c)
                    if size > max_tokens:
                        yield flush()
        if held:
            yield flush()

    dealt = store.materialize(groups.select("root", "label", "sets").mapInArrow(store.tidy(deal), _TOKENS), "jaccard-tokens", batch=100)

    def counted(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its members' tokens that several labels have, and how many have them."""
        block, idx, df, token = map(np.concatenate, zip(*found))
        order = np.argsort(block, kind="stable")
        block, idx, df, token = block[order], idx[order], df[order], token[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(block))):
            own = np.argsort(token[a:b], kind="stable")
            high = (token[a:b][own] >> np.uint64(32)).astype("<i4")
            blob = np.concatenate([token[a:b][own].astype("<u4").view("<i4"), high, idx[a:b][own].astype("<i4"), df[a:b][own].astype("<i4")]).tobytes()
            blob = int(b - a).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])]), pa.array([blob], pa.binary())], names=["block", "blob"])

    def count(batches):
        at, held, found, size = None, [], [], 0

        def several():
            cols = [np.concatenate(c) for c in zip(*((*x, np.full(len(x[0]), b, dtype=np.int64)) for x, b in held))]
            tok, idx, label, block = cols
            order = np.lexsort((label, tok))
            tok, idx, label, block = tok[order], idx[order], label[order], block[order]
            new = np.ones(len(tok), dtype=bool)
            new[1:] = tok[1:] != tok[:-1]
            other = new.copy()
            other[1:] |= label[1:] != label[:-1]
            group = np.cumsum(new) - 1
            df = np.bincount(group, other)[group].astype(np.int64)
            take = df > 1
            return block[take], idx[take], df[take], np.uint64(at) << np.uint64(32) | tok[take].astype(np.uint64)

        for batch in batches:
            for r, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r != at:
                    found.append(several())
                    size += len(found[-1][0])
                    held = []
                    if size > 500_000:
                        yield from counted(found)
                        found, size = [], 0
                at = r
                held.append((_unpack(blob, "<i4", "<i8"), block))
        if held:
            found.append(several())
        if found:
            yield from counted(found)

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blobs = dealt.where("range IS NOT NULL").select("range", "block", "blob").repartition(n, "range").sortWithinPartitions("range")
    back = blobs.mapInArrow(store.tidy(count), "block long, blob binary").select("block", "blob", F.lit(None).cast("binary").alias("members"))
    back = back.union(dealt.where("members IS NOT NULL").select("block", F.lit(None).cast("binary"), "members"))

    def choose(batches):
        at, pieces, table = None, [], None

        def keep():
            if not pieces:
                return None
            size, distinct, root, label = np.frombuffer(table, dtype="<i8").reshape(4, -1)
            cols = []
            for blob in pieces:
                k = int.from_bytes(blob[:4], "little")
                cols.append(np.frombuffer(pa.decompress(blob[4:], 16 * k, codec="zstd", asbytes=True), dtype="<i4").reshape(4, k))
            low, high, idx, df = np.concatenate(cols, axis=1)
            token = high.astype(np.int64) << 32 | low.view("<u4").astype(np.int64)
            order = np.lexsort((token, df, idx))
            token, idx = token[order], idx[order]
            starts = np.searchsorted(idx, np.arange(len(size)))
            held = np.diff(np.append(starts, len(idx)))
            room = t.missing(size) + 1 - (distinct - held)
            take = np.arange(len(idx)) - starts[idx] < room[idx]
            some = np.unique(np.stack([root[idx[take]], label[idx[take]], token[take]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in some.T], names=["root", "label", "token"]) if len(some) else None

        for batch in batches:
            for block, blob, members in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    if at is not None and (done := keep()) is not None:
                        yield done
                    at, pieces, table = block, [], None
                if members is not None:
                    table = members
                else:
                    pieces.append(blob)
        if at is not None and (done := keep()) is not None:
            yield done

    kept = back.repartition(n, "block").sortWithinPartitions("block").mapInArrow(store.tidy(choose), "root long, label long, token long")
    rare = store.materialize(kept.distinct(), "jaccard-rare")
    store.discard(dealt)
    return rare


def _with_labels(groups: DataFrame, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return groups.withColumn("label", F.col("root"))
    labels = _labels(edges).withColumnRenamed("node", "root")
    return groups.join(labels, "root", "left").withColumn("label", F.coalesce("label", "root"))


def _connect(groups: DataFrame, t: Threshold, n_ranges: int) -> DataFrame:
    """(root, label) after all links between groups."""
    # each group against the first group that shares a prefix token with it
    index = store.materialize(_prefixes(groups, t), "jaccard-prefixes", batch=100)
    leads = index.groupBy("token").agg(F.min("root").alias("lead"), F.max("root").alias("last")).where("lead < last").drop("last")
    sizes = store.materialize(groups.select("root", F.array_min("ns").alias("low"), F.array_max("ns").alias("high"), F.size("ns").alias("n_sets")), "jaccard-sizes")
    first = index.join(leads, "token").where("root > lead").select(F.col("lead").alias("a"), F.col("root").alias("b")).distinct()
    pairs = store.materialize(_of_like_size(first, sizes, t), "jaccard-first-pairs")
    edges = _linked_groups(pairs, groups, t)
    some = not edges.isEmpty()
    labelled = _with_labels(groups.select("root"), edges if some else None)
    roots = store.materialize(labelled.select("root", "label"), "jaccard-roots")

    # what is left: tokens whose groups are not yet connected, and all members of those groups
    open_ = index.join(roots, "root")
    split = open_.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("token")
    contested = store.materialize(open_.join(split, "token", "left_semi").select("root", "label").distinct(), "jaccard-contested")
    store.discard(index)
    rare = _rarest(groups.select("root", "sets").join(store.small(contested), "root"), t, n_ranges)
    met = _pairs(rare)
    store.discard(rare, contested)
    new = store.materialize(_of_like_size(met.where("lead IS NULL").select("a", "b"), sizes, t).join(pairs, ["a", "b"], "left_anti"), "jaccard-late-pairs")
    late = _linked_groups(new, groups, t)
    late = late.union(_linked_families(met.where("lead IS NOT NULL").select("lead", F.col("a").alias("root")), groups, roots.join(sizes.select("root", "n_sets"), "root"), t))
    store.discard(met, pairs, new, sizes)
    if late.isEmpty():
        return roots
    return store.materialize(_with_labels(groups.select("root"), edges.union(late)).select("root", "label"), "jaccard-roots")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", max_broadcast: int = 500_000) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and first (one row a component) of every row, for links of ``num / den`` or more.

    Text is lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than k words is
    one shingle. Without words, or null, a text is linked with nothing and its component is its
    own id. The component's id is the smallest doc_id in it; null ids take no part in that, and a
    component of null ids only has a null one. Repeated rows are linked like other copies.
    Other columns are ignored; an empty table stays empty.

    ``docs`` must give its rows in the same order when it is read again, as files do.
    """
    t = Threshold(num, den)
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    share = min(1.0, 2 * (den - num) / den)
    n_ranges = max(_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    scan = _scan(base, k, share, n_ranges)
    rows = store.materialize(scan.where("rid IS NOT NULL").select("rid", "doc_id", "n", "fp", "sampled", "local", "block", "idx"), "jaccard-documents")

    # a linked document lacks so few of a document's tokens, sampled ones included
    missing = F.floor(F.col("n") * (den - num) / den)
    supported = rows.where("n > 0").join(_support(scan), ["block", "idx"], "left").where(F.col("local") + F.coalesce("more", F.lit(0)) >= F.col("sampled") - missing)
    # a whole group of copies stands or falls together; one of them speaks for it
    kept = store.materialize(supported.groupBy("fp").agg(F.min("rid").alias("rid")), "jaccard-kept")
    store.discard(scan)
    few = kept.limit(max_broadcast + 1).count() <= max_broadcast
    speakers = kept.select("rid")

    def sets_of(batches):
        shingles = Shingler(k)
        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "n", "set"])

    spoken = base.select("rid", "text").join(F.broadcast(speakers) if few else speakers, "rid", "left_semi")
    sets = store.materialize(spoken.mapInArrow(store.tidy(sets_of), "rid long, n long, set binary"), "jaccard-sets")
    groups = _groups(sets, t, share)
    store.discard(sets)
    roots = _connect(groups, t, n_ranges)

    by_rid = groups.select("root", F.explode("rids").alias("rid")).join(roots, "root").select("rid", "label")
    names = by_rid.join(kept, "rid").select("fp", F.col("label"))
    d = rows.join(names, "fp", "left").withColumn("label", F.coalesce(F.col("label").cast("string").cast("binary"), "fp"))
    d = store.materialize(d.select("rid", "doc_id", F.col("n").alias("n_shingles"), "label"), "jaccard-rows")
    store.discard(groups, roots, kept, rows)
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid")
    first = d.where("label IS NOT NULL").groupBy("label").agg(F.min(rank).alias("first"))
    alone = F.col("n_shingles") == 0
    return d.join(first, "label", "left").select(
        "rid", "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.rid") == F.col("rid"))).alias("first"),
    )


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or of repeated rows the first."""
    out = components(docs, k, num, den, text, doc_id, max_broadcast)
    dropped = store.materialize(out.where(~F.col("first")).select(F.col("rid").alias("__rid")), "jaccard-dropped")
    few = dropped.limit(max_broadcast + 1).count() <= max_broadcast
    numbered = docs.select("*", F.monotonically_increasing_id().alias("__rid"))
    return numbered.join(F.broadcast(dropped) if few else dropped, "__rid", "left_anti").drop("__rid")
