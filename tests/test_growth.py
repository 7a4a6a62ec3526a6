"""Steps whose work or memory grew faster than their input, against a plain second way."""

import inspect
import math
import random

from pyspark.sql import functions as F

from plumbline.operators import matching, placing, robust, settling, spatial
from plumbline.plans import catalog, pictures  # noqa: F401 - pictures registers further queries


def test_corridors_at_the_limit(spark):
    """Distances just at the limit count as the SQL's sqrt of squares counts them."""
    rng = random.Random(5)
    rows = [("c", i % 2, i, rng.randrange(200) * 0.01, rng.randrange(200) * 0.01, -1.0 if i % 2 else 1.0, 0.0, None) for i in range(700)]
    doors = spark.createDataFrame(rows, "capture string, room int, opening int, x double, y double, nx double, ny double, width double")
    got = {(r.opening_a, r.opening_b) for r in settling.corridors(doors, apart=0.5, turn=8.5).collect()}
    at = [(x - n * 0.075, y) for _, _, _, x, y, n, _, _ in rows]
    gap = lambda i, j: math.sqrt(sum((p - q) * (p - q) for p, q in zip(at[i], at[j])))
    assert got == {(i, j) for i in range(0, 700, 2) for j in range(1, 700, 2) if gap(i, j) <= 0.5}


def test_nearest_within_makes_no_pairs(spark):
    """Many rows at few places: the nearest of another kind, ties to the smaller id, without rows for pairs."""
    rng = random.Random(4)
    left = [(i, rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3])) for i in range(200)]
    right = [(i, rng.choice([None, *range(0, 80, 2)]), rng.choice([None, 1, 1, 1, 2, 3])) for i in range(300)]
    right += [(1000, 75, 1), (999, 75, 2)]
    left += [(500, 85, 1), (501, 86, 1), (502, 70, 2), (503, 0, 3), (503, 9, 1)]
    a = spark.createDataFrame([(i, None if p is None else p / 2, k) for i, p, k in left], "a long, p double, ka int")
    b = spark.createDataFrame([(i, None if p is None else p / 2, k) for i, p, k in right], "b long, q double, kb int")
    for differ in (("ka", "kb"), None):
        out = spatial.nearest_within(a, b, "a", "b", "p", "q", 5.0, differ)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")
        got = sorted(out.select("a", "b", "distance").collect(), key=repr)
        fits = lambda k, m: differ is None or (k is not None and m is not None and k != m)  # noqa: E731, B023
        best: dict = {}
        for i, p, k in left:
            some = [(abs(p - q) / 2, j) for j, q, m in right if p is not None and q is not None and fits(k, m) and abs(p - q) <= 10]
            best[i] = min([*some, *([best[i]] if best.get(i) else [])], default=best.get(i))
        assert got == sorted([(i, best[i][1] if best[i] else None, best[i][0] if best[i] else None) for i, _, _ in left], key=repr)


def test_quantiles_as_percentile(spark):
    """Exact quantiles without one task holding a group's values: odd numbers, repeats, null keys and empty groups."""
    rng = random.Random(8)
    odd = [None, 0.0, -0.0, 1e-12, -1e-12, 5e-324, 1e300, -1e300, float("nan"), float("inf"), 7.0, 7.0]
    rows = [(k, rng.choice([x, rng.uniform(-1e5, 1e5), round(rng.uniform(0, 3), 1)])) for k in ("a", "b", None) for x in odd * 30]
    rows += [("none", None), ("one", 3.5), ("two", 1.0), ("two", 2.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    shares = {"lo": 0.001, "med": 0.5, "hi": 0.95}
    plain = lambda r: tuple(repr(x) for x in r)
    want = d.groupBy("k").agg(*[F.expr(f"percentile(v, {s})").alias(n) for n, s in shares.items()]).where("k IS NULL OR k <> 'none'")
    assert sorted(map(plain, robust.quantiles(d, "v", ["k"], shares).collect())) == sorted(map(plain, want.collect()))
    whole = d.agg(*[F.expr(f"percentile(v, {s})").alias(n) for n, s in shares.items()])
    assert list(map(plain, robust.quantiles(d, "v", [], shares).collect())) == list(map(plain, whole.collect()))
    assert [tuple(r) for r in robust.quantiles(d.where("false"), "v", [], shares).collect()] == [(None,) * 3]
    got = {r.k: r for r in robust.median_mad(d.where("v IS NULL OR abs(v) < 1e9"), "v", ["k"]).collect()}
    assert (got["two"].med, got["two"].spread, got["two"].n) == (1.5, 1.4826 * 0.5, 2)
    assert (got["none"].med, got["none"].spread, got["none"].n) == (None, None, 1)
    assert None in got


def test_named_queries_hold_no_values(spark, sf):
    for name in ("q08_robust_extent", "q09_median_mad", "q15_robust_interval", "q48_tolerance_gates", "q71_difference_shares"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan, name


def test_adjacency_of_sides_in_one_place(spark):
    """Many rooms on one another: the nearest other room, ties to the lesser name, and a row a doorway at most on the way."""
    rng = random.Random(6)
    rooms = {f"r{i:02}": (rng.randrange(8), rng.randrange(8), 2 + i % 2, 2) for i in range(60)}
    sides = {r: [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)] for r, (x, y, w, h) in rooms.items()}
    edges = spark.createDataFrame([("c", r, *map(float, s)) for r, some in sides.items() for s in some], "capture string, room string, x0 double, y0 double, x1 double, y1 double")
    doors = spark.createDataFrame([("c", r, "o" + r, float(x + w), y + h / 2, 0.9) for r, (x, y, w, h) in rooms.items()] + [("c", "r00", "far", 90.0, 90.0, None), ("c", "r00", "none", None, 1.0, None)], "capture string, room string, opening string, x double, y double, width double")
    named = doors.select("capture", F.col("room").alias("own"), "opening", "x", "y")
    assert placing._nearest_room(named, edges, 1.5).count() <= 60

    def gap(px, py, s):
        x0, y0, x1, y1 = s
        return math.hypot(px - min(max(px, min(x0, x1)), max(x0, x1)), py - min(max(py, min(y0, y1)), max(y0, y1)))

    for r in placing.adjacency(doors, edges).collect():
        if r.opening in ("far", "none"):
            assert r.other is None and r.gap is None
            continue
        x, y, w, h = rooms[r.room]
        best = min((min(gap(x + w, y + h / 2, s) for s in some), o) for o, some in sides.items() if o != r.room)
        assert (r.gap, r.other) == (best if best[0] <= 1.5 else (None, None))


def test_matching_takes_a_row_at_a_time():
    assert "batch.to_pylist()" not in inspect.getsource(matching.match)
