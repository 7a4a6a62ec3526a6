"""Rooms glued at their doorways and settled over all doorways at once, against floors whose truth is known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import placing, settling

WALL = 0.15


def floor_of_rooms():
    """Nine rooms of 3 by 3 m in a square, a wall apart, with two doorways in every shared wall; own frames turned and shifted."""
    rng = np.random.default_rng(6)
    step, edges, doors, truth, wide = 3 + WALL, [], [], {}, {}
    for i in range(3):
        for j in range(3):
            name, turn, at = f"r{i}{j}", rng.uniform(-3, 3) if (i, j) != (1, 1) else 0.0, np.array([i * step, j * step])
            truth[name] = (turn, at)
            c, s = np.cos(turn), np.sin(turn)
            own = lambda p: (np.array(p, float) - (1.5, 1.5)) @ np.array([[c, -s], [s, c]])  # noqa: B023, E731
            box = [own(p) for p in ((0, 0), (3, 0), (3, 3), (0, 3))]
            edges += [("a", name, k, *map(float, (*box[k], *box[(k + 1) % 4]))) for k in range(4)]
            gates = [g for t in (0.6, 2.1) for g in (((3, t + 0.1 * j), i < 2), ((0, t + 0.1 * j), i > 0), ((t - 0.1 * i, 3), j < 2), ((t - 0.1 * i, 0), j > 0))]
            for k, (g, there) in enumerate(gates):
                if there:  # both sides of a doorway are as wide, and no other one is
                    spot = tuple(np.round((at + g) / step * 2 - (0, 0.01) if k % 4 < 2 else (at + g) / step * 2 - (0.01, 0), 0)) + (k // 4, k % 4 // 2)
                    doors.append(("a", name, k, f"{name}_d{k}", *map(float, own(g)), wide.setdefault(spot, 0.6 + 0.35 * len(wide))))
    return edges, doors, truth


EDGES = "capture string, room string, seq int, x0 double, y0 double, x1 double, y1 double"
DOORS = "capture string, room string, seq int, opening string, x double, y double, width double"


def placed(truth, off, root="r11"):
    """Places as glue gives them, each off by what ``off`` says."""
    rows = []
    for name, (turn, at) in truth.items():
        da, dx, dy = off.get(name, (0, 0, 0))
        rows.append(("a", name, float(turn + da), float(at[0] + dx), float(at[1] + dy), None if name == root else root, None, None, 0.0, None, None, True))
    return rows


def places(df):
    return {r.room: (r.angle, r.sx, r.sy) for r in df.collect()}


@pytest.fixture(scope="module")
def rooms(spark):
    e, d, truth = floor_of_rooms()
    return spark.createDataFrame(e, EDGES), spark.createDataFrame(d, DOORS), truth


def test_normals_point_into_rooms(rooms):
    edges, doors, _ = rooms
    for r in placing.facing(doors, edges).collect():
        # a room's middle is the origin of its frame, 1.5 m from each side
        assert r.nx * r.x + r.ny * r.y == pytest.approx(-1.5, abs=1e-9) and np.hypot(r.nx, r.ny) == pytest.approx(1)


def test_rooms_settle(spark, rooms):
    edges, doors, truth = rooms
    rng = np.random.default_rng(1)
    off = {n: (rng.normal(0, 0.01), *rng.normal(0, 0.03, 2)) for n in truth if n != "r11"}
    p = spark.createDataFrame(placed(truth, off), placing.PLACED)
    got = places(settling.refine(edges, doors, p))
    for name, (turn, at) in truth.items():
        assert np.hypot(got[name][1] - at[0], got[name][2] - at[1]) < 0.002 and abs(got[name][0] - turn) < 0.001
    assert got["r11"] == (0.0, *truth["r11"][1])


def test_one_wrong_doorway_is_outvoted(spark, rooms):
    """A doorway seen 13 cm beside its place, and rooms up to 2 cm off."""
    edges, doors, truth = rooms
    c, s = np.cos(truth["r01"][0]), np.sin(truth["r01"][0])
    bad = F.col("opening") == "r01_d0"
    doors = doors.withColumn("x", F.when(bad, F.col("x") + 0.13 * s).otherwise(F.col("x"))).withColumn("y", F.when(bad, F.col("y") + 0.13 * c).otherwise(F.col("y")))
    rng = np.random.default_rng(2)
    off = {n: (0.0, *rng.uniform(-0.014, 0.014, 2)) for n in truth if n != "r11"}
    got = places(settling.refine(edges, doors, spark.createDataFrame(placed(truth, off), placing.PLACED)))
    assert max(np.hypot(got[n][1] - at[0], got[n][2] - at[1]) for n, (_, at) in truth.items()) < 0.02


def test_too_few_pairs_move_nothing(spark, rooms):
    edges, doors, truth = rooms
    few = doors.where("opening IN ('r11_d0', 'r21_d1', 'r01_d0', 'r11_d1')")
    off = {"r21": (0.01, 0.02, 0.03), "r01": (0.0, -0.02, 0.0)}
    p = spark.createDataFrame(placed(truth, off), placing.PLACED)
    assert places(settling.refine(edges, few, p)) == places(p)
    assert places(settling.refine(edges, doors.limit(0), p)) == places(p)


def test_rooms_that_nothing_ties_stay(spark, rooms):
    """Two rooms whose doorways meet only each other, far from the root."""
    pairs = [("a", "p", f"o{k}", "q", f"o{k}", float(k), 0.0, float(k) + 0.05, 0.0, 0.05, 0.0) for k in range(4)]
    pairs = spark.createDataFrame(pairs, "capture string, room_a string, opening_a string, room_b string, opening_b string, qx_a double, qy_a double, qx_b double, qy_b double, apart double, degrees double")
    for root, n in (("z", 0), ("p", 1)):
        rows = settling.settle(pairs, spark.createDataFrame([("a", root)], "capture string, room string")).collect()
        assert len(rows) == n
    assert rows[0].room == "q" and (rows[0].turn, rows[0].dx, rows[0].dy) == pytest.approx((0, -0.05, 0), abs=1e-9)


def test_pairs_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        a = rng.choice([0, 90, 180, 270]) + rng.uniform(-6, 6)
        rows.append((str(k % 2), f"r{k % 7}", f"o{k}", *map(float, rng.uniform(0, 3, 2)), float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))))
    rows += [("0", "r1", "odd", None, 1.0, 1.0, 0.0), ("0", None, "odd", 1.0, 1.0, 1.0, 0.0), ("0", "r1", "odd", 1.0, 1.0, None, None)]
    got = settling.corridors(spark.createDataFrame(rows, "capture string, room string, opening string, x double, y double, nx double, ny double"))
    want = set()
    for a in rows[:400]:
        for b in rows[:400]:
            q = lambda r: np.array(r[3:5]) - np.array(r[5:7]) * WALL / 2
            turned = np.degrees(np.arccos(np.clip(-np.dot(a[5:7], b[5:7]), -1, 1)))
            if a[0] == b[0] and a[1] < b[1] and np.hypot(*(q(a) - q(b))) <= 0.15 and turned <= 8:
                want.add((a[2], b[2]))
    assert {(r.opening_a, r.opening_b) for r in got.collect()} == want and len(want) > 20


def test_placed_rooms_reach_documents(spark, rooms):
    """Rooms in their own frames, one without a doorway: the others are placed, settled and described."""
    from plumbline.plans import contract, stitching

    edges, doors, truth = rooms
    shape = {n: [(r.x0, r.y0) for r in sorted(g, key=lambda r: r.seq)] for n in truth if (g := edges.where(F.col("room") == n).collect())}
    shape["alone"] = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    gates = {n: [r for r in doors.collect() if r.room == n] for n in shape}
    m = lambda v, u: {"value": v, "lo": v and v * 0.99, "hi": v and v * 1.01, "unit": u, "method": "tape", "note": None}
    pt = lambda p: {"x": p[0], "y": p[1]}
    made = [
        {"id": n, "name": n, "frame": "room", "polygon": [pt(p) for p in q], "walls": [{"id": f"{n}_w{k}", "start": pt(q[k]), "end": pt(q[(k + 1) % 4]), "length": m(3.0, "m"), "evidence": "wall_points"} for k in range(4)],
         "openings": [{"id": g.opening, "kind": "doorway", "wall_id": None, "start": pt((g.x, g.y)), "end": pt((g.x, g.y)), "centre": pt((g.x, g.y)), "width": m(g.width, "m")} for g in gates[n]],
         "stations": [{"position": pt((0.0, 0.0)), "height_above_floor": 1.5}], "floor_area": m(9.0 if n != "alone" else 4.0, "m2"), "damage": [], "flags": []}
        for n, q in shape.items()
    ]
    made = [{**r, "walls": r["walls"], "ceiling_height": None, "concealed_flags": [], "scope": []} for r in made]
    plans = spark.createDataFrame([{"capture": "a", "tier": "photo", "rooms": made}, {"capture": "empty", "tier": "photo", "rooms": []}], contract.schema())
    out = {r.capture: r for r in stitching.place(plans, lambda d: d.cache()).collect()}
    st = out["a"].stitching
    assert [p.room for p in st.placements] == sorted(truth) and st.unplaced == ["alone"] and st.drift == stitching.PLACED
    assert st.footprint.value == pytest.approx(81, abs=0.5) and out["empty"].stitching.footprint.value is None
    assert sum(x.other is not None and x.mutual for x in st.links) == sum(map(len, gates.values()))
    # places hold up to one motion of all rooms: compare distances between the rooms' middles
    middle = {r.id: np.mean([(p.x, p.y) for p in r.polygon], axis=0) for r in out["a"].rooms}
    station = {r.id: (r.stations[0].position.x, r.stations[0].position.y) for r in out["a"].rooms}
    gap = lambda p, q: np.hypot(*(np.array(p) - q))
    for a in truth:
        assert station[a] == pytest.approx(middle[a], abs=1e-6)
        for b in truth:
            assert gap(middle[a], middle[b]) == pytest.approx(gap(truth[a][1], truth[b][1]), abs=0.005)
    assert [(p.x, p.y) for p in next(r for r in out["a"].rooms if r.id == "alone").polygon] == shape["alone"]
