"""Free floor about a station in a room whose walls are known."""

import numpy as np
import pytest

from plumbline.operators import fan


def cloud():
    """A station in a room 4 by 3 m, 1 m from its left wall; a stray point, a table below the band and a gap to the right."""
    rng = np.random.default_rng(7)
    rows = []
    for x0, z0, x1, z1 in ((-1, -1.5, 3, -1.5), (-1, 1.5, 3, 1.5), (-1, -1.5, -1, 1.5), (3, -1.5, 3, -0.4), (3, 0.4, 3, 1.5)):
        t = rng.uniform(0, 1, 6000)
        rows += [("a", *p) for p in np.column_stack([x0 + t * (x1 - x0), rng.uniform(0.0, 2.5, 6000), z0 + t * (z1 - z0)]).tolist()]
    rows += [("a", 0.3, 1.0, 0.3), ("a", None, 1.0, 1.0), ("a", 1.0, None, 1.0)]
    rows += [("a", float(x), 0.1, 0.5) for x in np.linspace(-0.5, 0.5, 400)]
    return rows


def plain(rows):
    sectors = {}
    for _, x, y, z in rows:
        if None not in (x, y, z) and 0.25 < y < 2.05:
            sectors.setdefault(int(np.floor((np.degrees(np.arctan2(x, z)) + 180) / 2)), []).append(np.hypot(x, z))
    out = {(None, 0): (0.0, 0.0)}
    for k, r in sectors.items():
        reach = np.percentile(r, 10) - 0.3
        if len(r) >= 20:
            a = np.radians((k + 0.5) * 2 - 180)
            for n in range(1, 200):
                if n * 0.05 < reach - 1e-9:
                    out[k, n] = (np.sin(a) * n * 0.05, np.cos(a) * n * 0.05)
    return out


def test_fan_fills_the_room(spark):
    rows = cloud()
    points = spark.createDataFrame(rows, "capture string, x double, y double, z double")
    stations = spark.createDataFrame([("a", 0.0), ("empty", 0.0)], "capture string, floor double")
    got = fan.of_cloud(points, stations).collect()
    own = {(r.sector, r.step): (r.x, r.z) for r in got if r.capture == "a"}
    want = plain(rows)
    assert set(own) == set(want)
    for k, p in want.items():
        assert own[k] == pytest.approx(p, abs=1e-9)
    # within the walls, nothing through the gap, and most of the room is open
    p = np.array(list(own.values()))
    assert (np.abs(p[:, 1]) < 1.5).all() and (p[:, 0] > -1).all() and (p[:, 0] < 3).all()
    assert {(r.x, r.z) for r in got if r.capture == "empty"} == {(0.0, 0.0)}
    cells = {(int(np.floor(x / 0.25)), int(np.floor(z / 0.25))) for x, z in p}
    assert len(cells) > 0.6 * 16 * 12
    assert fan.of_cloud(points.limit(0), stations.limit(0)).collect() == []
