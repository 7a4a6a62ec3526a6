"""Operators 11 to 13 against plain Python versions of their contracts, and the parts they are made of."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm import clusters, simhash, spelling

from .helpers import key, odd_docs
from .helpers import odd_texts as _odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def joined(links, nodes):
    """The smallest node that each is connected with."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# operator 11


def plain_clusters(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            x = [int(np.floor(256.0 * float(np.float64(x)))) for x in v]
            if max(map(abs, x)) <= clusters.LARGEST:
                kept.append((i, x))
    lot = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], dtype=np.int32).tobytes())
    c = [x for _, x in sorted(kept, key=lot)[:k]]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min((gap(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[nearest(x)[1]].append(x)
        c = [[sum(s) // len(of[j]) for s in zip(*of[j])] if j in of else y for j, y in enumerate(c)]
    last = [(i, *nearest(x)) for i, x in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last]


def odd_vectors():
    rng = random.Random(5)
    centre = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    near = [(i, [x + rng.gauss(0, 0.05) for x in centre[i % 9]]) for i in range(150)]
    same = [(1000 + i, near[0][1]) for i in range(60)]
    odd = [(2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [0.5] * 63 + [float("nan")]), (2004, [float("-inf")] * 64), (2005, []), (2006, [0.0] * 64), (2007, [1e30] * 64)]
    return near + same + odd + [(None, centre[1]), near[3], near[3], (2008, [400000.0] + [0.0] * 63), (2009, [-0.001] * 64)]


@pytest.mark.parametrize("k", [40, 3, 300])
def test_clusters_of_odd_vectors(spark, k):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, vec int").repartition(5)
    assert key(rows_of(clusters.cluster(df, k=k))) == key(plain_clusters(rows, k=k))


def test_clusters_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert key(rows_of(clusters.cluster(df))) == key(plain_clusters(rows))


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows_of(clusters.cluster(empty)) == []
    assert rows_of(clusters.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>"))) == []


def test_bounds_stay_exact_and_save_distances():
    rng = np.random.default_rng(1)
    x = (rng.integers(0, 6, 4000)[:, None] * 300 + rng.normal(0, 40, (4000, 64))).astype(np.int32)
    c = x[rng.choice(4000, 40, replace=False)].astype(np.int64)
    state, asked = clusters.Bounds.scanned(x, c, 10), 0
    count = clusters.some_distances
    for turn in range(6):
        new = c.copy()
        for j in range(40):
            if (state.cluster == j).any():
                new[j] = x[state.cluster == j].sum(axis=0, dtype=np.int64) // (state.cluster == j).sum()
        shift = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + 1e-12)
        c = new
        state.narrowed(10 - turn)
        state.moved(x, c, shift)
        d = clusters.distances(x, c)
        assert (state.cluster == d.argmin(axis=1)).all()
        far = np.sqrt(d)
        assert (state.upper >= far.min(axis=1)).all()
        assert (state.low <= np.take_along_axis(far, state.near, axis=1)).all()
        others = np.ones_like(d, dtype=bool)
        np.put_along_axis(others, np.column_stack([state.cluster, state.near]), False, axis=1)
        assert (state.rest <= np.where(others, far, np.inf).min(axis=1)).all()
    # once centroids stand still, no distance is worked out
    before = state.upper.copy()
    clusters.some_distances = lambda *a: pytest.fail("bounds certify nothing")
    try:
        far_apart = state.upper < state.low[:, 0]
        some = clusters.Bounds(*(getattr(state, n)[far_apart] for n in ("cluster", "upper", "near", "low", "rest")))
        assert some.moved(x[far_apart], c, np.zeros(40)) == 0
    finally:
        clusters.some_distances = count
    assert far_apart.mean() > 0.5 and len(before) == 4000


# operator 12


def plain_spelling(docs, ratio=10):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[(w[:i] + w[i + 1 :], i)].add(w)
    near = defaultdict(set)
    for (rest, _), ws in holes.items():
        for a in ws:
            near[a] |= ws - {a}
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def slips(seed=4):
    """Texts in which a few words occur with all sorts of slips."""
    rng = random.Random(seed)
    letters = "abcdeéß÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(30)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(1, 30)])
            while rng.random() < 0.35:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :]]) or w
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("most", [1000, 3])
def test_spelling_of_slips(spark, most):
    docs = slips() + [(None, "a" * 9 + " " + "a" * 8), (7, "a" * 9 + " " + "b" * 5000 + " " + "a" * 8), (8, "b" * 4999), (9, "b" * 4999 + "\n" + "b" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(7)
    have = rows_of(spelling.variants(df, most=most))
    want = plain_spelling(docs)
    assert key(have) == key(want)
    assert sum(r[3] is not None for r in want) > 100 and any(r[3] not in (None, r[5]) for r in want)


def test_spelling_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert key(rows_of(spelling.variants(docs))) == key(plain_spelling(rows))
    assert rows_of(spelling.variants(docs.limit(0))) == []


def test_one_edit_leaves_a_common_key():
    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 11)))
        p = rng.randrange(len(w))
        v = rng.choice([w[:p] + rng.choice("abcd") + w[p:], w[:p] + rng.choice("abcd") + w[p + 1 :]])
        if v != w:
            frequency = {a + b: rng.randrange(4) for a, b in itertools.product("abcd", repeat=2)}
            short, long = sorted((w, v), key=len)
            keys = lambda x, role: {spelling.key_of(x, s, f, b) for s, r, f, b in spelling.cuts(x, frequency) if r == role}
            assert keys(short, False) & keys(long, len(w) != len(v)), (w, v)


# operator 13


def plain_fingerprint(text):
    w = [x.lower() for x in WORD.findall((text or "").translate(LOWER))]
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(docs):
    fp = [(i, plain_fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in fp})
    to = joined([(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 4], distinct)
    least = defaultdict(list)
    for i, f in fp:
        if i is not None:
            least[to[f]].append(i)
    return [(i, f"{f:016x}", min(least[to[f]], default=None)) for i, f in fp]


def near_texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    out = [(100 + i, t) for i, t in enumerate(_odd_texts())]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for copy in range(12):
            some = list(base)
            for _ in range(rng.randint(0, 3)):
                some[rng.randrange(len(some))] = rng.choice(words)
            out.append((family * 1000 + copy + 500, " ".join(some)))
    return out + [(None, ""), (None, None), out[30], (None, "alone and without a name at all")]


@pytest.mark.parametrize("most", [2048, 12])
def test_simhash(spark, most):
    docs = near_texts()
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, fp int, label int").repartition(6)
    want = plain_simhash(docs)
    assert key(rows_of(simhash.components(df, most=most))) == key(want)
    assert len({r[2] for r in want}) < len({r[1] for r in want})


def test_simhash_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert key(rows_of(simhash.components(df))) == key(plain_simhash([(r.doc_id, r.text) for r in df.collect()]))
    assert rows_of(simhash.components(df.limit(0))) == []


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ np.uint64(n) for n in range(30)]]))
    have = {(int(a), int(b)) for i, j in simhash.links(fps, radius, block=50) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert have == want
    assert len(fps) > 300


def test_dense_fingerprints_are_cut_until_they_fit(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(600)}
    signed = [simhash._signed(f) for f in fps]
    edges = rows_of(simhash.near(spark.createDataFrame([(f,) for f in signed], "fp long"), most=150))
    to = joined(edges, signed)
    want = joined([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], signed)
    assert to == want
