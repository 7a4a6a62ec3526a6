"""Operator 6 on large families, frequent passages and split leads, against brute force."""

import functools
import random

import pytest

from plumbline.llm import similarity, store


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def family_rows(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows, base, passage = [], [word() for _ in range(60)], [word() for _ in range(12)]
    for i in range(150):  # one template, from exact copies to versions far from each other
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(150, 260):  # a passage that many share in texts of their own
        rows.append((i, " ".join([word() for _ in range(rng.randrange(0, 30))] + passage + [word() for _ in range(rng.randrange(0, 10))])))
    for i in range(260, 300):  # short texts and copies of them
        rows.append((i, rng.choice(["", None, "one", "one two", "ONE two", " ".join(passage[:7]), " ".join(passage[1:8])])))
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_families(spark, monkeypatch, small):
    rows = family_rows()
    if small:  # every group, lead and family is split, and nothing is broadcast
        monkeypatch.setattr(similarity, "_groups", functools.partial(similarity._groups, most=6))
        monkeypatch.setattr(similarity, "_pairs", functools.partial(similarity._pairs, most=5, rows_a_task=10))
        monkeypatch.setattr(similarity, "_linked_families", functools.partial(similarity._linked_families, size=7))
        monkeypatch.setattr(similarity, "_rarest", functools.partial(similarity._rarest, max_tokens=300))
        monkeypatch.setattr(store, "small", lambda df, most=0: df)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    d = store.materialize(d, "families")
    out = similarity.components(d, k=4, num=85, den=100, max_broadcast=0 if small else 500_000)
    assert {tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()} == brute(rows, 4, 85, 100)
