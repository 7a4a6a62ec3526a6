"""Doorway links, floors, gluing, damage rules and scope, on small plans with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import findings, placing, rules

EDGES = "capture string, room string, seq int, x0 double, y0 double, x1 double, y1 double"
DOORS = "capture string, room string, seq int, opening string, x double, y double, width double"


def sides(room, corners, capture="c"):
    return [(capture, room, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_adjacency_overlap_footprint(spark):
    e = spark.createDataFrame(sides("a", box(0, 0, 4, 3)) + sides("b", box(4.15, 0, 4, 3)) + sides("d", box(20, 0, 3, 3)) + sides("a", box(0, 0, 2, 2), "z"), EDGES)
    d = spark.createDataFrame([("c", "a", 0, "a0", 4.0, 1.5, 0.9), ("c", "b", 0, "b0", 4.15, 1.5, 0.9), ("c", "d", 0, "d0", 20.0, 1.5, 0.9)], DOORS)
    got = {r["opening"]: (r["other"], r["gap"], r["mutual"]) for r in placing.adjacency(d, e).collect()}
    assert got["a0"][0] == "b" and got["a0"][1] == pytest.approx(0.15) and got["a0"][2]
    assert got["d0"] == (None, None, False)
    runs = placing.floor_runs(e)
    area = {r["capture"]: r["area"] for r in placing.footprint(runs).collect()}
    assert area["c"] == pytest.approx(33, abs=0.05) and area["z"] == pytest.approx(4, abs=0.01)
    assert placing.overlaps(runs).count() == 0
    moved = spark.createDataFrame(sides("a", box(0, 0, 4, 3)) + sides("b", box(3.5, 0, 4, 3)), EDGES)
    (o,) = placing.overlaps(placing.floor_runs(moved)).collect()
    assert (o["a"], o["b"]) == ("a", "b") and o["area"] == pytest.approx(1.5, abs=0.01)
    assert placing.footprint(placing.floor_runs(moved)).first()["area"] == pytest.approx(22.5, abs=0.01)


def winding(polygon, at):
    """Whether an outline goes once round a place, by the sum of the angles its corners are seen under."""
    seen = np.arctan2(*(polygon[None] - at[:, None]).transpose(2, 0, 1)[::-1])
    return np.abs(((np.diff(seen, axis=1, append=seen[:, :1]) + np.pi) % (2 * np.pi) - np.pi).sum(1)) > np.pi


def test_floor_runs_against_every_cell(spark):
    ring = [(0.0, 0.0), (3.1, -0.4), (2.2, 1.7), (3.4, 3.3), (0.7, 2.1), (-0.9, 3.9)]
    runs = placing.floor_runs(spark.createDataFrame(sides("a", ring), EDGES), 0.1).collect()
    got = {(x, r["iy"]) for r in runs for x in range(r["a"], r["b"] + 1)}
    g = np.array([(x, y) for x in range(-20, 50) for y in range(-20, 60)])
    at, p, q = (g + 0.5) * 0.1, np.array(ring), np.roll(np.array(ring), -1, 0)
    off = np.abs((q - p)[:, 0] * (at[:, None, 1] - p[:, 1]) - (q - p)[:, 1] * (at[:, None, 0] - p[:, 0])).min(1)
    border = set(map(tuple, g[off < 1e-9].tolist()))  # a centre on a side is neither in nor out
    assert got - border == set(map(tuple, g[winding(p, at)].tolist())) - border


def test_glue_puts_turned_rooms_back(spark):
    """A hall with three doors and three rooms, each turned and moved; widths tell the doors apart."""
    truth = {"hall": box(0, 0, 6, 2), "p": box(0, 2.15, 3, 3), "q": box(3.3, 2.15, 2.7, 3), "r": box(1, -3.15, 4, 3)}
    doors = [("hall", "h0", 1.5, 2.0, 0.8), ("hall", "h1", 4.6, 2.0, 1.15), ("hall", "h2", 3.0, 0.0, 1.5), ("p", "p0", 1.5, 2.15, 0.8), ("q", "q0", 4.6, 2.15, 1.15), ("r", "r0", 3.0, -0.15, 1.5)]
    pose = {"hall": (0, 0, 0), "p": (1.0, 3, -2), "q": (-2.2, 0, 5), "r": (0.4, 1, 1)}
    turn = lambda t: np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    go = lambda r, p: tuple(turn(pose[r][0]) @ np.array(p, float) + pose[r][1:])
    e = spark.createDataFrame([s for r, c in truth.items() for s in sides(r, [go(r, p) for p in c])] + sides("alone", box(0, 0, 1, 1)), EDGES)
    d = spark.createDataFrame([("c", r, k, o, *map(float, go(r, (x, y))), w) for k, (r, o, x, y, w) in enumerate(doors)], DOORS)
    placed = placing.glue(e, d)
    assert [r["room"] for r in placed.where("NOT placed").collect()] == ["alone"]
    back = {(r["room"], r["seq"]): (r["x0"], r["y0"]) for r in placing.move(e, placed).collect()}
    for room, corners in truth.items():
        for k, c in enumerate(corners):
            assert back[room, k] == pytest.approx(c, abs=0.01)


DAMAGE = "capture string, room string, id string, kind string, surface string, class string, x double, y double, length double, area double, lo double, hi double"


def test_rules_and_scope(spark):
    e = [(c, r, f"{r}_w{k}", *s) for c, r, k, *s in sides("a", box(0, 0, 4, 3)) + sides("b", box(4.15, 0, 4, 3))]
    walls = spark.createDataFrame(e, "capture string, room string, wall string, x0 double, y0 double, x1 double, y1 double")
    damage = spark.createDataFrame([
        ("c", "a", "d0", "ceiling", "a_ceiling", "water_stain", 3.8, 1.5, None, 0.2, 0.1, 0.3),
        ("c", "a", "d1", "wall", "a_w1", "water_stain", 1.4, 0.5, None, 0.3, 0.2, 0.4),
        ("c", "a", "d2", "wall", "a_w0", "structural_crack", 1.0, 1.5, 0.7, None, None, None),
        ("c", "a", "d3", "wall", "a_w0", "structural_crack", 2.0, 1.5, None, None, None, None),
        ("c", "b", "d4", "wall", "b_w1", "soot_or_fire", 1.0, 1.0, None, 0.5, 0.4, 0.6),
    ], DAMAGE)
    flags = findings.concealed(damage, walls)
    got = {(r["rule"], tuple(r["damage_ids"]), r["other"]) for r in flags.collect()}
    assert got == {
        ("ceiling_stain_source_above", ("d0",), None), ("wall_stain_under_ceiling_stain", ("d1", "d0"), None), ("stain_on_shared_wall", ("d1",), "b"),
        ("moisture_low_on_wall", ("d1",), None), ("long_crack_continues_behind_finish", ("d2",), None), ("soot_char_behind_surface", ("d4",), None),
    }
    work = findings.scope(damage, flags).collect()
    repair = {r["damage_ids"][0]: (r["value"], r["unit"]) for r in work if r["action"] != findings.INSPECT}
    assert repair == {"d0": (0.2, "m2"), "d1": (0.3, "m2"), "d2": (0.7, "m"), "d3": (None, "m"), "d4": (0.5, "m2")}
    inspect = {r["surface"]: (r["damage_ids"], r["value"]) for r in work if r["action"] == findings.INSPECT}
    assert inspect == {"a_ceiling": (["d0"], 0.2), "a_w1": (["d1"], 0.3), "a_w0": (["d2"], 0.0), "b_w1": (["d4"], 0.5)}


def test_classes(spark):
    d = spark.createDataFrame([(1, -20.0, 0.0, 1.0, 0.02, 2.0, 0.9, 0.5, 0.0, 0.0), (2, -10.0, 1.0, 8.0, 0.02, 2.0, 0.9, 0.5, 0.0, 9.0), (3, None, None, None, None, None, None, None, None, None)], "k int, dl double, da double, db double, area double, edge_cm double, solidity double, busy double, a_abs double, b_abs double")
    got = d.select("k", rules.classify([(F.expr(c), n) for n, c in findings.CLASSES], "other_anomaly").alias("class")).collect()
    assert {r["k"]: r["class"] for r in got} == {1: "soot_or_fire", 2: "water_stain", 3: "other_anomaly"}
