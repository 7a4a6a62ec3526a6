"""One value far off every other must not become endless rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.tables import writer
from plumbline.operators import robust, spatial


def test_overlaps_with_an_endless_interval(spark):
    rng = random.Random(3)
    rows = [("k", i, s, s + rng.choice([0.0, 0.3, 1.0, 5.0, 40.0])) for i, s in enumerate(rng.uniform(0, 60) for _ in range(60))]
    rows += [("k", 100, -5.0, 1e12), ("k", 101, -1e11, 1e11), ("other", 102, 0.0, 60.0), ("k", 103, 3.0, 1.0), ("k", 104, None, 2.0)]
    got = {(r.a, r.b): r.shared for r in spatial.overlaps(spark.createDataFrame(rows, "g string, id long, s double, e double"), "g", "id", "s", "e").collect()}
    want = {}
    for (g, a, s0, e0), (h, b, s1, e1) in itertools.combinations([r for r in rows if r[2] is not None and r[3] >= r[2]], 2):
        shared = min(e0, e1) - max(s0, s1)
        if g == h and shared > 0 and shared >= 0.5 * min(e0 - s0, e1 - s1):
            want[min(a, b), max(a, b)] = shared
    assert got == pytest.approx(want) and len(want) > 100


def test_histogram_with_a_stray_value(spark):
    d = spark.range(2000).select((F.col("id") % 40).cast("double").alias("v")).union(spark.createDataFrame([(1e12,), (None,)], "v double"))
    bins = robust.histogram(d, "v", 1.0)
    assert bins.count() == 41 and robust.mode(bins).first().bin == 3 and robust.highest_peak(bins).first().bin == 36
    assert [tuple(r) for r in robust.thin_stretches(bins).collect()] == [(40, 10**12, 10**12 - 39)]
    near = spatial.knn(*[spark.createDataFrame([(i, float(i), 0.0) for i in range(300)] + [(999, 1e9, 0.0)], "id long, x double, y double")] * 2, 2, ["x", "y"], writer(spark, "knn"))
    assert {r.near for r in near.where("id = 50").collect()} == {49, 51}
