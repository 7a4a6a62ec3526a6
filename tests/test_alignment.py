"""A second walk through known rooms is laid on the first; every shift is counted as by hand."""

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.operators import alignment

CELLS = "capture string, ix long, iz long"
CELL = alignment.CELL
ROOMS = {"hall": (0.0, 0.0, 4.6, 3.1), "kitchen": (4.75, 0.0, 8.0, 2.4), "bath": (4.75, 2.55, 6.9, 4.4)}
DEGREES, SHIFT = 37.0, (2.3, -1.15)


def corners(box):
    x0, z0, x1, z1 = box
    return [(x0, z0), (x1, z0), (x1, z1), (x0, z1)]


def seen_again(p):
    """Where the second walk, in a frame of its own, has a place of the first."""
    t = np.radians(DEGREES)
    return (np.asarray(p, float) - SHIFT) @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])


def walk(name, frame, rooms):
    cells, inside, walls = set(), set(), []
    for room in rooms:
        c = corners(ROOMS[room])
        for k, (p, q) in enumerate(zip(c, c[1:] + c[:1])):
            t = np.linspace(0, 1, 400)[:, None]
            cells |= {tuple(v) for v in np.floor(frame(np.array(p) + t * (np.array(q) - p)) / CELL).astype(int).tolist()}
            (x0, z0), (x1, z1) = frame([p, q]).tolist()
            walls.append((name, room if name == "a" else room[::-1], k, x0, z0, x1, z1))
        x0, z0, x1, z1 = ROOMS[room]
        g = np.stack(np.meshgrid(np.arange(x0, x1, CELL / 3), np.arange(z0, z1, CELL / 3)), -1).reshape(-1, 2)
        inside |= {(name, room if name == "a" else room[::-1], *v) for v in np.floor(frame(g) / CELL).astype(int).tolist()}
    return [(name, *c) for c in sorted(cells)], sorted(inside), walls


def test_second_walk(spark):
    a = walk("a", lambda p: np.asarray(p, float), ["hall", "kitchen", "bath"])
    b = walk("b", seen_again, ["hall", "kitchen"])
    cells = spark.createDataFrame(a[0] + b[0] + [("a", None, 0), ("empty", None, None)], CELLS)
    rooms = spark.createDataFrame(a[1] + b[1], "capture string, room string, ix long, iz long")
    walls = spark.createDataFrame(a[2] + b[2], "capture string, room string, wall int, x0 double, z0 double, x1 double, z1 double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "empty"), ("a", None)], "a string, b string")
    got = alignment.compare(cells, rooms, walls, pairs, writer(spark, "align"))
    found = got["alignment"].collect()
    assert [(r.a, r.b, r.degrees) for r in found] == [("a", "b", DEGREES)]
    assert found[0].share > 0.95
    assert (found[0].dx * CELL, found[0].dz * CELL) == (pytest.approx(SHIFT[0], abs=1.5 * CELL), pytest.approx(SHIFT[1], abs=1.5 * CELL))
    matches = {r.room: r for r in got["rooms"].collect()}
    assert {k: r.other for k, r in matches.items()} == {"llah": "hall", "nehctik": "kitchen"}
    assert all(r.iou > 0.9 for r in matches.values())
    lines = got["walls"].collect()
    assert {(r.room[::-1], r.wall) for r in lines} == {(room, k) for room in ("hall", "kitchen") for k in range(4)}
    assert all(r.wall == r.other_wall and r.len == pytest.approx(r.other_len) and r.off < 0.1 for r in lines)
    assert [(r.walls, r.median, r.within_gate) for r in got["summary"].collect()] == [(8, pytest.approx(0, abs=1e-9), 1.0)]


def test_shifts_by_hand():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = np.unique(rng.integers(-6, 7, (rng.integers(1, 25), 2)), axis=0) + rng.integers(-50, 50, 2)
        b = np.unique(rng.integers(-4, 9, (rng.integers(1, 25), 2)), axis=0)
        votes = {}
        for x, z in a.tolist():
            for u, v in b.tolist():
                votes[x - u, z - v] = votes.get((x - u, z - v), 0) + 1
        n, _, _, dx, dz = max((n, -s[1], -s[0], *s) for s, n in votes.items())
        assert alignment.shifts(a, b) == (dx, dz, n)


def test_turns_and_empty_tables(spark):
    c = np.array([[0, 0], [3, 1], [-2, 5]])
    assert alignment.turn(c, 90).tolist() == sorted([-z - 1, x] for x, z in c.tolist())
    none = spark.createDataFrame([], CELLS)
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert alignment.align(none, pairs).collect() == []
    one = spark.createDataFrame([("a", 5, 7), ("b", 1, 1)], CELLS)
    r = alignment.align(one, pairs).first()
    assert (r.hits, r.of, r.share) == (1, 1, 1.0)
