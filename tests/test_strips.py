"""Rulers and strips planted in drawn pictures; truth is kept beside each picture."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.tables import writer
from plumbline.operators import strips

WIDE, HIGH = 240, 320


def colour(hue, s, v):
    """RGB of a hue in steps of two degrees."""
    return tuple(round(255 * c) for c in colorsys.hsv_to_rgb(hue / 180, s, v))


WALL, YELLOW, WOOD, WHITE = colour(100, 0.1, 0.5), colour(25, 0.8, 0.9), colour(19.6, 0.6, 0.8), (250, 250, 250)


def bar(picture, rgb, centre, long, wide, lean):
    """A bar whose axis leans from upright by ``lean`` degrees to the right at its lower end; its ends as (u, v)."""
    a = np.radians(lean)
    axis, side = np.array([np.sin(a), np.cos(a)]), np.array([np.cos(a), -np.sin(a)])
    v, u = np.mgrid[: picture.shape[0], : picture.shape[1]]
    d = np.stack([u - centre[0], v - centre[1]], axis=-1)
    picture[(np.abs(d @ axis) <= long / 2) & (np.abs(d @ side) <= wide / 2)] = rgb
    return np.array(centre) - axis * long / 2, np.array(centre) + axis * long / 2


def scenes():
    rng = np.random.default_rng(12)
    pictures, truth = {}, {}
    for k in range(6):
        p = np.full((HIGH, WIDE, 3), WALL)
        centre, lean = rng.uniform((60, 90), (180, 230)), rng.uniform(-25, 25)
        truth[f"ruler_{k}"] = bar(p, YELLOW, centre, 95, 12, lean)
        pictures[f"ruler_{k}"] = p
    p = pictures["ruler_0"]
    p[40:44, 70:90] = WALL  # nothing of the ruler's colour
    for name, draw in {
        "empty": lambda p: None,
        "level": lambda p: bar(p, YELLOW, (120, 160), 95, 12, 80),
        "pipe": lambda p: bar(p, YELLOW, (120, 160), 200, 9, 3),
        "block": lambda p: bar(p, YELLOW, (120, 160), 60, 25, 0),
        "cut_off": lambda p: bar(p, YELLOW, (120, 20), 95, 12, 0),
        "wood": lambda p: bar(p, WOOD, (120, 160), 95, 12, 0),
        "speckles": lambda p: [bar(p, YELLOW, (40 + 30 * i, 100 + 20 * i), 8, 5, 0) for i in range(5)],
        "white_wall": lambda p: p.__setitem__((slice(None), slice(0, 200)), WHITE),
    }.items():
        p = np.full((HIGH, WIDE, 3), WALL)
        draw(p)
        pictures[name] = p
    # a gap in the ruler of 3 pixels, as a line of print leaves
    p = np.full((HIGH, WIDE, 3), WALL)
    truth["printed"] = bar(p, YELLOW, (100, 150), 95, 12, 0)
    p[148:151] = WALL
    pictures["printed"] = p
    # two white strips; the longer one is on the right
    p = np.full((HIGH, WIDE, 3), WALL)
    truth["left"], truth["right"] = bar(p, WHITE, (70, 160), 60, 10, 0), bar(p, WHITE, (170, 160), 110, 12, 10)
    pictures["white"] = p
    return pictures, truth


def table(spark, pictures):
    rows = []
    for name, p in pictures.items():
        v, u = np.mgrid[: p.shape[0], : p.shape[1]]
        rows += [("c", name, *x) for x in np.column_stack([u.ravel(), v.ravel(), p.reshape(-1, 3)]).tolist()]
    return spark.createDataFrame(rows, "capture string, frame string, u long, v long, r long, g long, b long").repartition(8).cache()


@pytest.fixture(scope="module")
def drawn(spark):
    pictures, truth = scenes()
    return table(spark, pictures), truth


def ends(r):
    return np.array([[r.upper.u, r.upper.v], [r.lower.u, r.lower.v]])


def test_rulers(spark, drawn):
    pixels, truth = drawn
    got = {r.frame: r for r in strips.find_rulers(pixels, writer(spark, "rulers"), 60).collect()}
    assert set(got) == {n for n in truth if n.startswith("ruler") or n == "printed"}
    for name, r in got.items():
        assert np.abs(ends(r) - np.array(truth[name])).max() < 1.5 and abs(r.length - 95) < 2 and abs(r.width - 12) < 2.5


def test_strips(spark, drawn):
    pixels, truth = drawn
    save = writer(spark, "strips")
    some = pixels.where("frame IN ('white', 'white_wall', 'empty')")
    (r,) = strips.find_strips(some, save).collect()
    assert r.frame == "white" and np.abs(ends(r) - np.array(truth["right"])).max() < 1.5
    near = spark.createDataFrame([("c", "white", 75.0, 150.0)], "capture string, frame string, near_u double, near_v double")
    (r,) = strips.find_strips(some, save, near=near).collect()
    assert np.abs(ends(r) - np.array(truth["left"])).max() < 1.5
    far = near.withColumn("near_v", F.lit(300.0))
    assert strips.find_strips(some, save, near=far).collect() == []
    got = {r.frame for r in strips.find_strips(pixels.where("frame IN ('ruler_1', 'pipe', 'block', 'level')"), save, "yellow_video").collect()}
    assert got == {"ruler_1", "pipe"}
    with pytest.raises(ValueError):
        strips.coloured(pixels, "green")


def test_nothing_to_find(spark, drawn):
    none = drawn[0].limit(0)
    assert strips.find_rulers(none, writer(spark, "none"), 60).collect() == []
    nulls = spark.createDataFrame([("c", "x", 1, 1, None, 2, 3), ("c", "x", None, 1, 250, 250, 250)], none.schema)
    assert strips.find_strips(nulls, writer(spark, "none")).collect() == []


def test_hues(spark):
    rgb = [(r, g, b) for r in (0, 3, 90, 255) for g in (0, 17, 90, 254) for b in (0, 90, 200)]
    d = spark.createDataFrame([tuple(map(float, x)) for x in rgb], "r double, g double, b double")
    for row in d.select("r", "g", "b", *strips.hsv(F.col("r"), F.col("g"), F.col("b"))).collect():
        h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in row[:3]))
        assert min(abs(row[3] - 180 * h), 180 - abs(row[3] - 180 * h)) <= 0.5001 and abs(row[4] - 255 * s) <= 0.5001 and row[5] == pytest.approx(255 * v)


def test_moments_of_patches(spark):
    """Two patches against numpy: a slanted line of cells and a square."""
    line = [(k, 2 * k + d) for k in range(10) for d in (0, 1)]
    box = [(100 + i, 50 + j) for i in range(4) for j in range(4)]
    rows = [("c", "f", x, y, (n,)) for n, cells in ((1, line), (2, box)) for x, y in cells]
    d = spark.createDataFrame(rows, "capture string, frame string, ix long, iz long, label struct<n: int>")
    for r in strips.moments(d).collect():
        p = np.array(line if r.label.n == 1 else box, float)
        spread, axes = np.linalg.eigh(np.cov(p.T, bias=True))
        assert (r.area, r.left, r.bottom) == (len(p), p[:, 0].min(), p[:, 1].max())
        assert (r.along**2, r.across**2) == pytest.approx(tuple(spread[::-1]), abs=1e-9)
        if r.label.n == 1:
            assert abs(np.dot(axes[:, 1], (r.ax, r.ay))) == pytest.approx(1) and r.ay > 0
        else:
            assert (r.ax, r.ay) == (1, 0)
