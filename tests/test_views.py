"""Rays, views and scales against small cases worked out by hand."""

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.operators import dense, rays

RAYS = "capture string, frame int, chunk int, ox double, oy double, oz double, ex double, ey double, ez double"


def test_carve(spark):
    r = spark.createDataFrame([("c", f, f // 2, 0.025, 1.0, 0.025, 0.98, 1.0, 0.025) for f in range(3)] + [("c", 0, 0, 0.025, 1.0, 0.025, 0.98, 1.0, 0.025), ("c", 7, 1, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0)], RAYS)
    h = spark.createDataFrame([("c", 0.0)], "capture string, floor double")
    votes = rays.carve(r, h, margin_abs=0.1, margin_rel=0.0)
    got = {(v["chunk"], v["ix"], v["iz"]): v["frames"] for v in votes.collect()}
    assert got == {(c, x, 0): n for c, n in ((0, 2), (1, 1)) for x in range(18)}
    assert {(v["ix"], v["iz"]) for v in rays.seen(votes).collect()} == {(x, 0) for x in range(18)}
    deep = spark.createDataFrame([("c", 0, 0, 0.0, 1.0, 0.0, 2.0, -1.0, 0.0)], RAYS)
    assert max(v["ix"] for v in rays.carve(deep, h, margin_abs=0.0, margin_rel=0.0).collect()) <= 20


def test_doorways(spark):
    """A wall at z = 4 with a door from 2.0 to 2.9 m: half of the rays there end in the room behind."""
    rng, rows = np.random.default_rng(4), []
    for f in range(40):
        o = rng.uniform((1, 0.5), (4, 3))
        for x in rng.uniform(0, 5, 150):
            d = (x - o[0], 4 - o[1])
            k = 1 + 2.0 / d[1] if 2.0 < x < 2.9 else 1.0
            rows.append(("c", f, 0, float(o[0]), 1.4, float(o[1]), float(o[0] + k * d[0]), 1.0, float(o[1] + k * d[1])))
    e = spark.createDataFrame([("c", 0, 2, 5.0, 4.0, 0.0, 4.0, 5.0), ("c", 0, 0, 0.0, 0.0, 5.0, 0.0, 5.0)], "capture string, room int, wall int, x0 double, z0 double, x1 double, z1 double, len double")
    (d,) = rays.doorways(spark.createDataFrame(rows, RAYS), e).collect()
    assert d["wall"] == 2 and (d["t0"], d["t1"]) == (pytest.approx(2.1, abs=0.05), pytest.approx(3.0, abs=0.05))


def test_best_views(spark):
    g = [("s", f, k, q) for f, spots in {1: (0, 1, 2), 2: (0, 1, 2, 3), 3: (4,), 4: (4,)}.items() for k in spots for q in (1.0,)]
    d = spark.createDataFrame(g + [("s", 5, 0, 0.001)], "surface string, frame int, spot int, quality double")
    got = rays.best_views(d, writer(spark, "views")).collect()
    assert sorted((r["place"], r["frame"]) for r in got) == [(0, 2), (1, 3)]
    assert rays.best_views(d.limit(0), writer(spark, "views")).count() == 0


def test_ratios_and_scale(spark):
    rows = [("c", f, f // 5, 2.0 * (1 + 0.001 * k) * (9 if k == 0 else 1), 1.0) for f in range(10) for k in range(40)] + [("c", 99, 0, 1.0, 1.0), ("c", 0, 0, 1.0, 0.0)]
    f = dense.frame_ratios(spark.createDataFrame(rows, "capture string, frame int, chunk int, depth double, z double"))
    assert f.count() == 10
    m = dense.model_scale(dense.chunk_ratios(f))
    assert m.first()["scale"] == pytest.approx(2.04, abs=0.01)
    rng = np.random.default_rng(0)
    top, bottom = np.array([0, 1.0, 3]), np.array([0, 0.5, 3])
    unit = lambda v: v / np.linalg.norm(v)
    sight = [("c", k, *map(float, (o := rng.uniform(-1, 1, 3))), *map(float, unit(top - o)), *map(float, unit(bottom - o))) for k in range(20)]
    sight.append(("c", 20, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0))  # a wrong one
    s = spark.createDataFrame(sight, "capture string, frame int, ox double, oy double, oz double, tx double, ty double, tz double, bx double, by double, bz double")
    lengths = dense.known_length(s)
    r = lengths.first()
    assert r["length"] == pytest.approx(0.5, abs=1e-6) and r["frames"] == 20
    assert dense.choose_scale(m, lengths, 1.0).first()["method"] == "known length"
    bad = dense.choose_scale(m, lengths, 5.0).first()
    assert bad["method"] == "depth model" and len(bad["flags"]) == 1
    assert dense.choose_scale(m, lengths.limit(0), 1.0).first()["flags"] == ["the object of known length was not seen"]


def test_edges_of_depth_go(spark):
    px = [("c", "f", u, v, 1.0 if u < 3 else 2.0) for u in range(6) for v in range(4)] + [("c", "f", 9, 9, 0.0)]
    d = dense.depth_edges(spark.createDataFrame(px, "capture string, frame string, u int, v int, z double"))
    assert {r["u"] for r in d.collect()} == {0, 1, 4, 5}


def test_harmony_and_chains(spark):
    true = {0: 0.3, 1: -0.2, 2: -0.1, 7: 0.5, 8: -0.5}
    pairs = [("r", i, j, true[j] - true[i], 0.02) for i, j in ((0, 1), (1, 2), (0, 2), (7, 8))]
    got = {r["photo"]: r["log_scale"] for r in dense.harmonise(spark.createDataFrame(pairs, "room string, i int, j int, log_ratio double, spread double")).collect()}
    assert got == pytest.approx(true, abs=1e-9)
    links = spark.createDataFrame([("r", 0, 1, 50), ("r", 1, 2, 40), ("r", 0, 2, 10), ("r", 7, 8, 99)], "room string, i int, j int, inliers int")
    got = {r["photo"]: (r["component"], r["parent"], r["depth"]) for r in dense.spanning_chains(links).collect()}
    assert got == {1: (0, None, 0), 0: (0, 1, 1), 2: (0, 1, 1), 7: (1, None, 0), 8: (1, 7, 1)}
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    a = np.random.default_rng(2).normal(size=(9, 3))
    assert np.allclose(dense.kabsch(a, a @ q.T), q)
