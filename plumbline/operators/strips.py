"""Rulers and strips of one colour in pictures: pixels by hue, patches by labels, and their shape from moments.

``pixels`` has capture, frame, u (column), v (row) and r, g, b from 0 to 255. All pictures are gone
through at once; a patch's moments are sums over its pixels, so no picture is held in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import grid

BY = ("capture", "frame")

# Fixed values. Hue runs from 0 to 180, saturation and value from 0 to 255.
COLOURS = {
    "white": "s < 60 AND v > 150",
    "yellow": "h BETWEEN 28 AND 42 AND s > 90 AND v > 150",
    "yellow_video": "h BETWEEN 20 AND 45 AND s > 90 AND v > 140",
    "ruler": "h BETWEEN 19 AND 34 AND s > 100 AND v > 140",
}
LEAST_AREA = 150
MOST_SHARE = 0.05
UPRIGHT = 0.82
STRIP_ELONGATION = 3.5
STRIP_NEAR = 0.25
RULER_ASPECT = (5.0, 13.0)
RULER_TRUE_ASPECT = 7.9
RULER_HUE = 22
RULER_FILL = 0.7


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in steps of two degrees, saturation and value, each rounded to a whole number; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    hue = F.when(span > 0, F.pmod(F.round(30 * turn), F.lit(180.0))).otherwise(0.0)
    return hue, F.when(top > 0, F.round(255 * span / top)).otherwise(0.0), top


def coloured(pixels: DataFrame, colour: str) -> DataFrame:
    """(capture, frame, u, v, hue) of the pixels of a colour; an unknown colour is an error."""
    if colour not in COLOURS:
        raise ValueError(f"colours are {', '.join(COLOURS)}, not {colour!r}")
    d = pixels.select(*BY, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("__v"), *[F.col(c).cast("double").alias(c) for c in "rgb"])
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    return d.withColumns({"h": h, "s": s, "v": v}).where(COLOURS[colour]).select(*BY, "u", F.col("__v").alias("v"), F.col("h").alias("hue"))


def closed(cells: DataFrame, steps: int, by: tuple[str, ...] = BY) -> DataFrame:
    """Gaps up to 2 * ``steps`` cells wide are filled."""
    d = cells
    for _ in range(steps):
        d = grid.dilate(d, by=by)
    for _ in range(steps):
        d = grid.erode(d, by=by)
    return d


def moments(labelled: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """A row a patch of (by, ix, iz, label): area, box, centre, and the long axis with the spreads along and across it.

    Spreads are root mean squares; the axis is a unit vector that points down (``ay`` not negative),
    or to the right if it is level. A patch as long as it is broad has the axis (1, 0).
    """
    x, y = F.col("ix").cast("double"), F.col("iz").cast("double")
    sums = [F.sum(c).alias(n) for n, c in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]
    box = [f(c).alias(n) for n, f, c in (("left", F.min, "ix"), ("right", F.max, "ix"), ("top", F.min, "iz"), ("bottom", F.max, "iz"))]
    d = labelled.groupBy(*by, "label").agg(F.count("*").alias("area"), *box, *sums)
    n = F.col("area")
    d = d.withColumns({"cx": F.col("sx") / n, "cy": F.col("sy") / n})
    d = d.withColumns({"vxx": F.greatest(F.lit(0.0), F.col("sxx") / n - F.col("cx") * F.col("cx")), "vyy": F.greatest(F.lit(0.0), F.col("syy") / n - F.col("cy") * F.col("cy")), "vxy": F.col("sxy") / n - F.col("cx") * F.col("cy")})
    half, gap = (F.col("vxx") + F.col("vyy")) / 2, (F.col("vxx") - F.col("vyy")) / 2
    d = d.withColumn("swing", F.hypot(gap, F.col("vxy")))
    angle = F.when(F.col("swing") > 1e-9, F.atan2(F.col("vxy"), gap) / 2).otherwise(0.0)
    d = d.withColumn("angle", F.when(angle < 0, angle + F.pi()).otherwise(angle))
    return d.select(*by, "label", "area", "left", "right", "top", "bottom", "cx", "cy", F.cos("angle").alias("ax"), F.sin("angle").alias("ay"), F.sqrt(half + F.col("swing")).alias("along"), F.sqrt(F.greatest(F.lit(0.0), half - F.col("swing"))).alias("across"))


def patches(pixels: DataFrame, colour: str, save: Callable[[DataFrame], DataFrame], steps: int) -> DataFrame:
    """Patches of a colour that may be a strip: moments, length and width along the axes, both ends, and the median hue.

    They have at least 150 pixels and at most a twentieth of their picture's, touch no border and
    stand within 35 degrees of upright. Null places and colours take no part.
    """
    sizes = pixels.groupBy(*BY).agg((F.max("u") + 1).alias("wide"), (F.max("v") + 1).alias("high"))
    some = save(coloured(pixels, colour))
    cells = closed(some.select(*BY, F.col("u").alias("ix"), F.col("v").alias("iz")), steps)
    labelled = save(grid.components(cells, save, by=BY))
    m = moments(labelled).join(sizes, [*BY])
    inner = (F.col("left") > 1) & (F.col("top") > 1) & (F.col("right") + 1 < F.col("wide") - 1) & (F.col("bottom") + 1 < F.col("high") - 1)
    m = m.where(inner & (F.col("area") >= LEAST_AREA) & (F.col("area") <= MOST_SHARE * F.col("wide") * F.col("high")) & (F.abs("ay") >= UPRIGHT))
    few = labelled.join(m.select(*BY, "label", "cx", "cy", "ax", "ay"), [*BY, "label"]).join(some.select(*BY, F.col("u").alias("ix"), F.col("v").alias("iz"), "hue"), [*BY, "ix", "iz"], "left")
    t = (F.col("ix") - F.col("cx")) * F.col("ax") + (F.col("iz") - F.col("cy")) * F.col("ay")
    s = (F.col("iz") - F.col("cy")) * F.col("ax") - (F.col("ix") - F.col("cx")) * F.col("ay")
    # a patch is a twentieth of a picture at most, so its hues have few values and rows
    ends = few.groupBy(*BY, "label").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), (F.max(s) - F.min(s)).alias("width"), F.median("hue").alias("hue"))
    d = m.join(ends, [*BY, "label"]).withColumn("length", F.col("t1") - F.col("t0"))
    end = lambda k: F.struct((F.col("cx") + F.col("ax") * F.col(k)).alias("u"), (F.col("cy") + F.col("ay") * F.col(k)).alias("v"))
    return d.select(*BY, "wide", "high", "area", "cx", "cy", "ax", "ay", "along", "across", "length", "width", "hue", end("t0").alias("upper"), end("t1").alias("lower"), F.col("label.iz").alias("row"), F.col("label.ix").alias("column"))


def find_strips(pixels: DataFrame, save: Callable[[DataFrame], DataFrame], colour: str = "white", least_length: float = 40.0, near: DataFrame | None = None, steps: int = 3) -> DataFrame:
    """(capture, frame, upper, lower, length): the longest strip of each picture; pictures without one have no row.

    With ``near`` (capture, frame, near_u, near_v) pictures named there take the strip nearest to that
    place instead, a quarter of the picture's width away at most. Ties go to the upper, then the left one.
    """
    d = patches(pixels, colour, save, steps).where((F.col("across") > 1e-6) & (F.col("along") >= STRIP_ELONGATION * F.col("across")) & (F.col("length") >= least_length))
    score = -F.col("length")
    if near is not None:
        d = d.join(near, [*BY], "left").withColumn("gap", F.hypot(F.col("cx") - F.col("near_u"), F.col("cy") - F.col("near_v")))
        d = d.where(F.col("gap").isNull() | (F.col("gap") <= STRIP_NEAR * F.col("wide")))
        score = F.coalesce("gap", score)
    best = d.groupBy(*BY).agg(F.min(F.struct(score.alias("score"), "row", "column", "upper", "lower", "length")).alias("b"))
    return best.select(*BY, "b.upper", "b.lower", "b.length")


def find_rulers(pixels: DataFrame, save: Callable[[DataFrame], DataFrame], least_length: float, steps: int = 2) -> DataFrame:
    """(capture, frame, upper, lower, length, width): the yellow patch of each picture whose shape is nearest to the ruler's.

    Its length is 5 to 13 times its width, it fills its rectangle, and its median hue is off a wooden
    edge's. Ties go to the upper, then the left one; pictures without one have no row.
    """
    aspect = F.col("length") / F.col("width")
    d = patches(pixels, "ruler", save, steps).where((F.col("length") >= least_length) & (F.col("width") >= 1))
    d = d.where(aspect.between(*RULER_ASPECT) & (F.col("area") >= RULER_FILL * F.col("length") * F.col("width")) & (F.col("hue") >= RULER_HUE))
    best = d.groupBy(*BY).agg(F.min(F.struct(F.abs(F.log(aspect / RULER_TRUE_ASPECT)).alias("off"), "row", "column", "upper", "lower", "length", "width")).alias("b"))
    return best.select(*BY, "b.upper", "b.lower", "b.length", "b.width")
