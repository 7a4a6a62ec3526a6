"""The grid queries over every chunk, against brute force."""

from collections import defaultdict
from itertools import combinations

import pytest

from plumbline.operators import cloud
from plumbline.plans import catalog

NINE = [(dx, dz) for dx in (-1, 0, 1) for dz in (-1, 0, 1)]
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def cells(spark, sf):
    """Each chunk's cells, and those of components: how many points a cell has."""
    d = catalog._cloud(spark, sf)
    coarse, fine = defaultdict(set), defaultdict(lambda: defaultdict(int))
    for r in d.select("chunk", cloud.cell("x", 2.0).alias("ix"), cloud.cell("y", 5.0).alias("iz"), cloud.cell("y", 1.0).alias("iy")).collect():
        coarse[r.chunk].add((r.ix, r.iz))
        fine[r.chunk][r.ix, r.iy] += 1
    assert len(coarse) == 7
    return coarse, {c: {k for k, n in of.items() if n >= 2} for c, of in fine.items()}


def rows(spark, sf, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect())


def test_ious(spark, sf, cells):
    c = cells[0]
    want = [(a, b, len(c[a] & c[b]), len(c[a] | c[b])) for a, b in combinations(sorted(c), 2)]
    assert rows(spark, sf, "q25_mask_iou", "a", "b", "both", "either") == want


def test_cell_sets(spark, sf, cells):
    c = cells[0]
    want = [(a, b, *k, "both" if k in c[b] else "first") for a, b in combinations(sorted(c), 2) for k in c[a]]
    assert rows(spark, sf, "q27_cell_sets", "a", "b", "ix", "iz", "part") == sorted(want)


def test_components(spark, sf, cells):
    want = []
    for chunk, left in cells[1].items():
        left = set(left)
        while left:
            found, todo = [], [left.pop()]
            while todo:
                x, z = todo.pop()
                found.append((z, x))
                near = {(x + dx, z + dz) for dx, dz in NINE} & left
                left -= near
                todo += near
            want.append((chunk, *min(found), len(found)))
    assert rows(spark, sf, "q45_components", "chunk", "lz", "lx", "cells") == sorted(want)


def test_morphology(spark, sf, cells):
    want = []
    for chunk, c in cells[0].items():
        want += [("dilated", chunk, x, z) for x, z in {(x + dx, z + dz) for x, z in c for dx, dz in NINE}]
        want += [("eroded", chunk, x, z) for x, z in {(x + dx, z + dz) for x, z in c for dx, dz in NINE} if all((x + dx, z + dz) in c for dx, dz in NINE)]
    assert rows(spark, sf, "q47_morphology", "kind", "chunk", "ix", "iz") == sorted(want)


def test_pairs_that_share_nothing(spark):
    from plumbline.operators import grid

    d = spark.createDataFrame([("p", 0, 0), ("q", 5, 5), ("q", 6, 5), ("q", 6, 5)], "g string, ix long, iz long")
    assert [tuple(r) for r in grid.pair_ious(d, "g", ["ix", "iz"]).collect()] == [("p", "q", 0, 3)]
    assert {r.part for r in grid.pair_cell_sets(d, "g", ["ix", "iz"]).collect()} == {"first"}
