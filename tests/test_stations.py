"""Walls and outlines seen from one place, heights of noisy clouds, surfaces in pictures and sharp frames, by known rooms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import heights, outline, sharpness, stations, surfaces


def room_cells(w=5.0, d=4.0, door=None, seed=1):
    """Wall points of a w by d room in 2 cm cells, the station 2 m and 1.5 m from two walls."""
    rng = np.random.default_rng(seed)
    out = []
    for x0, z0, x1, z1 in ((0, 0, w, 0), (w, 0, w, d), (w, d, 0, d), (0, d, 0, 0)):
        n = int(np.hypot(x1 - x0, z1 - z0) / 0.02)
        t = np.linspace(0, 1, n)
        p = np.column_stack([x0 + t * (x1 - x0), z0 + t * (z1 - z0)])
        if door and (z0, z1) == (0, 0):
            p = p[(p[:, 0] < door[0]) | (p[:, 0] > door[1])]
        out.append(p)
    p = np.vstack(out) + rng.normal(0, 0.006, (sum(map(len, out)), 2)) - (2.0, 1.5)
    return p, np.full(len(p), 8.0)


def test_segments_and_outline(spark):
    rows = []
    for name, door in (("plain", None), ("door", (2.5, 3.4))):
        p, n = room_cells(door=door)
        rows += [(name, float(x), float(z), float(k)) for (x, z), k in zip(p, n)]
    found = stations.segments(spark.createDataFrame(rows, "capture string, x double, z double, n double")).cache()
    assert {r.capture: r.n for r in found.groupBy("capture").agg(F.count("*").alias("n")).collect()} == {"plain": 4, "door": 4}
    (door,) = [r for r in found.where("capture = 'door'").collect() if len(r.runs) == 2]
    assert door.runs[1].a - door.runs[0].b == pytest.approx(0.9, abs=0.1)
    corners = {c: [] for c in ("plain", "door")}
    for r in stations.outlines(found).orderBy("capture", "seq").collect():
        corners[r.capture].append((r.x, r.z))
        assert r.supported
    for c in corners.values():
        assert len(c) == 4 and abs(outline.signed_area(np.array(c))) == pytest.approx(20.0, rel=0.01)


def test_arcs():
    owner = np.array([1, 1, 1, -1, 2, 2, 2, 3, 2, 2, 2, -1, 1, 1, 1])
    assert stations.arcs(owner, 2) == [(1, -3, 2), (2, 4, 10)] or stations.arcs(owner, 2) == [(2, 4, 10), (1, 12, 17)]
    assert stations.arcs(np.full(5, -1), 2) == []


def test_square_and_consolidate():
    p, n = room_cells()
    line = lambda a, b: outline.fit_line(*[v[m] for m in [np.hypot(*(p - (a + b) / 2).T) < np.hypot(*(b - a)) / 2 + 0.01] for v in (p, n)])
    c = np.array([(0, 0), (2.5, 0), (5, 0), (5, 4), (0, 4)]) - (2.0, 1.5)
    edges = [outline.Edge(a, b, line(a, b), 1.0) for a, b in zip(c, np.roll(c, -1, 0))]
    edges = [e if e.line else outline.Edge(e.p0, e.p1) for e in edges]
    for e in edges:  # lines by the walls themselves
        t = (e.p1 - e.p0) / e.length
        m = np.array([-t[1], t[0]])
        e.line = (m, float(m @ e.p0))
    got = stations.consolidate(edges, p, n)
    assert len(got) == 4 and abs(outline.signed_area(np.array([e.p0 for e in got]))) == pytest.approx(20, rel=0.01)
    a = np.radians(4)
    bent = [outline.Edge(e.p0, e.p1, e.line, 1.0) for e in got]
    bent[0] = outline.Edge(bent[0].p0, bent[0].p1 + bent[0].length * np.array([0, np.sin(a)]), bent[0].line, 1.0)
    sides = [np.degrees(np.arctan2(*(e.p1 - e.p0)[::-1])) % 90 for e in stations.square(bent)]
    assert np.ptp([(s + 45) % 90 for s in sides]) < 1e-6


def test_heights(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 0.02, 4000), rng.normal(-1.2, 0.05, 900), rng.uniform(0, 2.6, 3000), rng.normal(2.6, 0.015, 2500)])
    d = spark.createDataFrame([("a", float(v)) for v in y], "capture string, y double")
    floor = heights.strongest_spike(d).first()
    assert floor.floor == pytest.approx(0, abs=0.02) and floor.support > 3000
    guess = spark.createDataFrame([("a", 0.1, 2.5), ("none", 0.0, None)], "capture string, floor double, ceiling double")
    got = {r.capture: r for r in heights.refine(d, guess).collect()}
    assert got["a"].floor == pytest.approx(0, abs=0.01) and got["a"].ceiling == pytest.approx(2.6, abs=0.01) and got["a"].refined and got["a"].floor_spread < 0.05
    assert got["none"].floor == 0.0 and got["none"].ceiling is None and not got["none"].refined


def test_surface_in_two_views(spark):
    walls = [(0.0, 0.0, 4.0, 0.0, True), (4.0, 0.0, 4.0, 3.0, True), (4.0, 3.0, 0.0, 3.0, True), (0.0, 3.0, 0.0, 0.0, False)]
    rooms = spark.createDataFrame([("c", "r0", 0.0, None, walls)], "capture string, room string, floor double, ceiling double, walls array<struct<x0: double, y0: double, x1: double, y1: double, seen: boolean>>")
    planes = surfaces.planes(rooms).cache()
    assert {r.surface for r in planes.collect()} == {"r0_w0", "r0_w1", "r0_w2", "r0_floor"}
    # cameras 1.5 m up in the room's middle that look at wall 0, which is at z = 0 with its inside towards -z
    pose = lambda k, x: ("c", k, x, 1.5, -2.0, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0, 60.0, 60.0, 40.0, 30.0, 80, 60)
    names = "capture string, frame int, cx double, cy double, cz double, r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double, fx double, fy double, px double, py double, wide int, high int"
    frames = spark.createDataFrame([pose(0, 1.8), pose(1, 2.2)], names)
    views = surfaces.looks_at(surfaces.lattice(planes), frames).cache()
    assert {r.surface for r in views.collect()} >= {"r0_w0"} and "r0_w2" not in {r.surface for r in views.collect()}
    near = lambda r, c: 1.4 if 20 < r < 40 and 30 < c < 50 else 2.0  # noqa: E731 - something stands before the wall
    pixels = spark.createDataFrame([("c", f, r, c, 0.5, 0.25 * (1 + f), 0.5, near(r, c)) for f in (0, 1) for r in range(60) for c in range(80)], "capture string, frame int, row int, col int, r double, g double, b double, z double")
    grid = surfaces.grid(planes.where("surface = 'r0_w0'"), 0.05)
    seen = surfaces.sightings(grid, views, frames, pixels, surfaces.depth_edges(pixels)).cache()
    patch = surfaces.patches(surfaces.level_exposure(seen)).where("valid").cache()
    assert patch.count() > 200 and patch.where("abs(relief) > 1e-6 OR abs(r - 0.5) > 0.3").count() == 0
    row = patch.where("g > 0.26 AND g < 0.49").count()
    assert row == patch.count()  # both views count
    behind = patch.where("row BETWEEN 28 AND 31 AND col BETWEEN 39 AND 40").count()
    assert behind == 0
    share = surfaces.coverage(patch, planes.where("surface = 'r0_w0'"), 0.05).first()
    assert 0 < share.seen <= 1


def test_sharp_frames(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f, s in enumerate((0.0, 1.0, 5.0, 0.5)):
        g = 100 + s * rng.normal(size=(12, 12))
        rows += [("c", f, i, j, float(g[i, j])) for i in range(12) for j in range(12)]
    d = sharpness.sharpness(spark.createDataFrame(rows, "capture string, frame int, row int, col int, grey double"))
    assert [r.frame for r in sharpness.sharpest_by_step(d, 2).orderBy("frame").collect()] == [1, 2]
    shifts = spark.createDataFrame([("c", 0, 1.0, 2.0, 0.3, -0.2, 0.1)], "capture string, chunk int, cx double, cz double, dx double, dz double, yaw double")
    from plumbline.operators import drift

    p = spark.createDataFrame([("c", 0, 4.0, 5.0), ("c", 9, 1.0, 1.0)], "capture string, chunk int, x double, z double")
    back = sharpness.undo(drift.correct(p, shifts), shifts).orderBy("chunk").collect()
    assert (back[0].x, back[0].z) == pytest.approx((4.0, 5.0)) and (back[1].x, back[1].z) == (1.0, 1.0)
