"""Planted tilts are found from walls; areas are told from lines."""

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.operators import levelling

POINT = "capture string, x double, y double, z double"
UP = "capture string, ux double, uy double, uz double"


def room(rng, n=24000):
    """Walls of an L-shaped room about a camera at the origin, a table and stray points; heights from -1.4 to 1.2 m."""
    corners = [(-1.7, -2.2), (2.9, -2.2), (2.9, 0.6), (0.8, 0.6), (0.8, 1.9), (-1.7, 1.9)]
    out = []
    for (x0, z0), (x1, z1) in zip(corners, corners[1:] + corners[:1]):
        t = rng.uniform(0, 1, n // 6)
        out.append(np.column_stack([x0 + t * (x1 - x0), rng.uniform(-1.4, 1.2, len(t)), z0 + t * (z1 - z0)]))
    out.append(np.column_stack([rng.uniform(0, 1, 2000), rng.normal(-0.7, 0.005, 2000), rng.uniform(-1, 0, 2000)]))
    out.append(rng.uniform(-2, 2, (800, 3)))
    p = np.concatenate(out)
    return p + rng.normal(0, 0.006, p.shape)


def turned(axis, degrees):
    a, t = np.array(axis, float) / np.linalg.norm(axis), np.radians(degrees)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


PLANTED = {"small": ((1, 0, 0.4), 2.3), "large": ((0.2, 0.1, -1), 23.7), "none": ((1, 0, 0), 0.0), "sideways": ((1, 0.3, 1), 11.1)}


def test_planted_tilts(spark):
    rng = np.random.default_rng(5)
    rows, priors, truth = [], [], {}
    for name, (axis, degrees) in PLANTED.items():
        r = turned(axis, degrees)
        rows += [(name, *p) for p in (room(rng) @ r.T).tolist()]
        truth[name] = r @ [0, 1, 0]
        priors.append((name, 0.0, 2.0, 0.0))
    rows += [("small", None, 0.0, 0.0), ("small", float("nan"), 0.0, 0.0), ("no prior", 0.0, 0.0, 0.0)]
    priors += [("no points", 3.0, 0.0, 4.0), ("no direction", 0.0, 0.0, 0.0), ("no direction", None, 1.0, 0.0)]
    save = writer(spark, "up")
    points = spark.createDataFrame(rows, POINT)
    got = {r.capture: r for r in levelling.up_from_walls(points, spark.createDataFrame(priors, UP), save).collect()}
    assert set(got) == {*PLANTED, "no points"}
    for name, up in truth.items():
        u = np.array([got[name].ux, got[name].uy, got[name].uz])
        assert np.linalg.norm(u) == pytest.approx(1)
        assert np.degrees(np.arccos(min(1, u @ up))) < 0.3, name
        assert got[name].tilt == pytest.approx(np.degrees(np.arccos(up[1])), abs=0.3) and not got[name].at_edge
    assert (got["no points"].ux, got["no points"].uz, got["no points"].tilt) == (pytest.approx(0.6), pytest.approx(0.8), pytest.approx(0, abs=1e-5))
    assert levelling.up_from_walls(points.limit(0), spark.createDataFrame([], UP), save).collect() == []


def test_edge_of_the_cone(spark):
    rng = np.random.default_rng(9)
    r = turned((1, 0, 0), 50)
    points = spark.createDataFrame([("far", *p) for p in (room(rng, 6000) @ r.T).tolist()], POINT)
    rounds = ((20.0, 5.0, 0.2), (5.0, 1.0, 0.1))
    got = levelling.up_from_walls(points, spark.createDataFrame([("far", 0.0, 1.0, 0.0)], UP), writer(spark, "up"), rounds).first()
    assert got.at_edge == (got.tilt >= 17) and got.tilt <= 25 + 1e-6


def plain(p, up, e, cell):
    h = p @ up
    s = p[(h > -0.6) & (h < 0.4)]
    a, b, total, mass = s @ e, s @ np.cross(up, e), 0, 0
    for t in levelling.PLANS:
        flat = np.column_stack([np.cos(t) * a + np.sin(t) * b, np.cos(t) * b - np.sin(t) * a])
        n = np.unique(np.floor(flat / cell), axis=0, return_counts=True)[1]
        total, mass = total + (n * n).sum(), mass + n.sum()
    return float(total / mass)


def test_scores_of_all_candidates(spark):
    p = room(np.random.default_rng(3), 3000)
    points = spark.createDataFrame([("a", *v, 1) for v in p.tolist()], POINT + ", n long")
    ways = levelling.candidates(levelling.frames(spark.createDataFrame([("a", 0.1, 1.0, 0.0)], UP)), 4.0, 2.0)
    got = levelling.thinness(points, ways, 0.1).collect()
    assert {(r.i, r.j) for r in got} == {(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4}
    for r in got:
        up, e = np.array([r.ux, r.uy, r.uz]), np.array([r.ex, r.ey, r.ez])
        assert up @ e == pytest.approx(0, abs=1e-12) and e @ e == pytest.approx(1)
        assert r.score == pytest.approx(plain(p, up, e, 0.1))


def test_spreads(spark):
    rng = np.random.default_rng(2)
    sets = {
        "floor": rng.uniform(-1, 1, (500, 3)) * [2.0, 0.01, 1.5], "line": rng.uniform(-1, 1, (500, 3)) * [2.0, 0.01, 0.05], "strip": rng.uniform(-1, 1, (500, 3)) * [9.0, 0.01, 0.7],
        "few": rng.uniform(-1, 1, (9, 3)), "ball": rng.normal(0, 1, (400, 3)), "same": np.ones((20, 3)),
    }
    r = turned((1, 2, 3), 40)
    sets = {k: v @ r.T for k, v in sets.items()}
    rows = [(k, *p) for k, v in sets.items() for p in v.tolist()] + [("floor", None, 1.0, 1.0)]
    got = {g.capture: g for g in levelling.spreads(spark.createDataFrame(rows, POINT), ["capture"]).collect()}
    for k, v in sets.items():
        s = np.linalg.svd(v - v.mean(0), compute_uv=False) / np.sqrt(len(v))
        assert (got[k].wide, got[k].narrow) == (pytest.approx(s[0], abs=1e-7), pytest.approx(s[1], abs=1e-7))
        assert got[k].n == len(v)
    assert {k for k in got if got[k].area} == {"floor", "ball"}
