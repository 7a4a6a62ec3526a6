"""Two scans of one place laid on each other: walls by turns and shifts, rooms by shared cells, walls by common lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import grid

# Metres, degrees, an overlap, a cosine.
CELL = 0.05
STEP = 1.0
LEAST_IOU = 0.5
ALONG = 0.98
APART = 0.25
LEAST_WALL = 1.0

TURNED = "a string, b string, degrees double, dx long, dz long, hits long, of long"
BLOCK = 12


def shifts(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(dx, dz, hits): the whole-cell shift of b's cells that lays most of them on a's; of equal ones the least dz, then dx.

    All shifts are counted at once as the product of two spectra, on a raster as large as both extents together.
    """
    low_a, low_b = a.min(0), b.min(0)
    span = a.max(0) - low_a + b.max(0) - low_b + 1
    size = [1 << int(n - 1).bit_length() for n in span]
    rasters = []
    for cells in (a - low_a, b - low_b):
        r = np.zeros(size, np.float64)
        r[cells[:, 0], cells[:, 1]] = 1
        rasters.append(np.fft.rfft2(r))
    n = np.rint(np.fft.irfft2(rasters[0] * np.conj(rasters[1]), size)).astype(np.int64)
    at = np.argwhere(n == n.max())
    reach = b.max(0) - low_b  # shifts below zero lie at the far end of the raster
    at = np.where(at >= np.array(size) - reach, at - np.array(size), at)
    x, z = min(at.tolist(), key=lambda s: (s[1], s[0]))
    return int(x + low_a[0] - low_b[0]), int(z + low_a[1] - low_b[1]), int(n.max())


def turn(cells: np.ndarray, degrees: float) -> np.ndarray:
    """The cells that the middles of cells fall into when they are turned about the origin, each once."""
    t = np.radians(degrees)
    p = (cells + 0.5) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    return np.unique(np.floor(p).astype(np.int64), axis=0)


def turned(cells: DataFrame, pairs: DataFrame, step: float = STEP) -> DataFrame:
    """(a, b, degrees, dx, dz, hits, of): for each turn of b the shift that lays most of its wall cells on or beside a's.

    ``cells`` has capture, ix, iz; ``pairs`` has a and b. A capture's wall cells, some ten thousand, are one row; a task
    takes ``BLOCK`` turns of a pair and holds one raster of the two extents. Pairs with a side that has no cells have no row.
    """
    known = cells.where("capture IS NOT NULL AND ix IS NOT NULL AND iz IS NOT NULL").select("capture", F.col("ix").cast("long").alias("ix"), F.col("iz").cast("long").alias("iz"))
    pack = lambda d, side, name: d.groupBy(F.col("capture").cast("string").alias(side)).agg(F.collect_list("ix").alias(f"x{name}"), F.collect_list("iz").alias(f"z{name}"))
    sides = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    d = sides.join(pack(grid.dilate(known, by=("capture",)), "a", "a"), "a").join(pack(known.distinct(), "b", "b"), "b")
    ways = int(round(360 / step))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((ways - 1) // BLOCK)))).repartition("a", "b", "block")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                a, b = np.column_stack([r.xa, r.za]), np.column_stack([r.xb, r.zb])
                rows = []
                for k in range(r.block * BLOCK, min(ways, (r.block + 1) * BLOCK)):
                    own = turn(b, k * step)
                    rows.append((r.a, r.b, k * step, *shifts(a, own), len(own)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TURNED.split(", ")])

    return d.mapInPandas(best, TURNED)


def align(cells: DataFrame, pairs: DataFrame, step: float = STEP) -> DataFrame:
    """The best row of ``turned`` for each pair, with the share of b's cells that lie on a's; of equal ones the least turn."""
    order = F.struct("hits", (-F.col("degrees")).alias("least"))
    d = turned(cells, pairs, step).groupBy("a", "b").agg(F.max_by(F.struct("degrees", "dx", "dz", "hits", "of"), order).alias("m"))
    return d.select("a", "b", "m.*", (F.col("m.hits") / F.col("m.of")).alias("share"))


def matched_rooms(rooms: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, room, other, iou, cells, other_cells): for each room of b the room of a that it shares most with.

    ``rooms`` has capture, room, ix, iz and ``found`` comes from ``align``. a's cells are taken back into b's frame,
    where both meet by cell, so no two rooms are compared that share none; rooms of b that meet none have no row.
    """
    c = rooms.select(F.col("capture").cast("string").alias("capture"), "room", F.col("ix").cast("long").alias("ix"), F.col("iz").cast("long").alias("iz")).distinct()
    size = c.groupBy("capture", "room").agg(F.count("*").alias("n"))
    t = F.radians("degrees")
    x, z = F.col("ix") - F.col("dx") + 0.5, F.col("iz") - F.col("dz") + 0.5
    back = c.withColumnRenamed("capture", "a").join(found.select("a", "b", "degrees", "dx", "dz"), "a")
    back = back.select("a", "b", F.col("room").alias("other"), F.floor(F.cos(t) * x + F.sin(t) * z).alias("ix"), F.floor(F.cos(t) * z - F.sin(t) * x).alias("iz"))
    both = back.join(c.withColumnRenamed("capture", "b"), ["b", "ix", "iz"]).groupBy("a", "b", "room", "other").agg(F.count("*").alias("both"))
    d = both.join(size.select(F.col("capture").alias("b"), "room", F.col("n").alias("cells")), ["b", "room"])
    d = d.join(size.select(F.col("capture").alias("a"), F.col("room").alias("other"), F.col("n").alias("other_cells")), ["a", "other"])
    # a turned cell can hold two middles or none: what is shared is at most the smaller room
    shared = F.least("both", "cells", "other_cells")
    d = d.withColumn("iou", shared / (F.col("cells") + F.col("other_cells") - shared))
    best = F.max_by(F.struct("other", "iou", "cells", "other_cells"), F.struct("iou", (-F.xxhash64("other")).alias("tie")))
    return d.groupBy("a", "b", "room").agg(best.alias("m")).select("a", "b", "room", "m.*")


def same_lines(walls: DataFrame, found: DataFrame, matches: DataFrame, cell: float = CELL) -> DataFrame:
    """(a, b, room, wall, len, other_wall, other_len, off): long walls of b's rooms and a's walls on the same line, the nearest each.

    ``walls`` has capture, room, wall, x0, z0, x1, z1 in metres. Only rooms that share half of their cells are compared;
    walls run within some 11 degrees of each other and the middle of a's lies within 25 cm of b's line.
    """
    w = walls.select(F.col("capture").cast("string").alias("capture"), "room", "wall", "x0", "z0", "x1", "z1").withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))).where("len > 0")
    t = F.radians("degrees")
    place = found.select("a", "b", "degrees", "dx", "dz").join(matches.where(F.col("iou") >= LEAST_IOU).select("a", "b", "room", "other"), ["a", "b"])
    d = w.where(F.col("len") > LEAST_WALL).withColumnRenamed("capture", "b").join(place, ["b", "room"])
    for k in "01":
        x, z = F.col(f"x{k}"), F.col(f"z{k}")
        d = d.withColumns({f"x{k}": F.cos(t) * x - F.sin(t) * z + F.col("dx") * cell, f"z{k}": F.sin(t) * x + F.cos(t) * z + F.col("dz") * cell})
    d = d.select("a", "b", "room", "other", "wall", "len", "x0", "z0", ((F.col("x1") - F.col("x0")) / F.col("len")).alias("ux"), ((F.col("z1") - F.col("z0")) / F.col("len")).alias("uz"))
    o = w.select(
        F.col("capture").alias("a"), F.col("room").alias("other"), F.col("wall").alias("other_wall"), F.col("len").alias("other_len"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("z0") + F.col("z1")) / 2).alias("mz"),
        ((F.col("x1") - F.col("x0")) / F.col("len")).alias("vx"), ((F.col("z1") - F.col("z0")) / F.col("len")).alias("vz"),
    )
    off = F.abs((F.col("mx") - F.col("x0")) * F.col("uz") - (F.col("mz") - F.col("z0")) * F.col("ux"))
    d = d.join(o, ["a", "other"]).withColumn("off", off).where((F.abs(F.col("ux") * F.col("vx") + F.col("uz") * F.col("vz")) >= ALONG) & (F.col("off") <= APART))
    best = F.min_by(F.struct("len", "other_wall", "other_len", "off"), F.struct("off", "other_len", F.xxhash64("other_wall").alias("tie")))
    return d.groupBy("a", "b", "room", "wall").agg(best.alias("m")).select("a", "b", "room", "wall", "m.*")


def repeatability(lines: DataFrame) -> DataFrame:
    """(a, b, walls, median, within_5cm, within_gate): how far lengths of walls on the same line differ; the gate is 1 cm or 0.5 %."""
    gap = F.abs(F.col("len") - F.col("other_len"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return lines.groupBy("a", "b").agg(
        F.count("*").alias("walls"), F.median(gap).alias("median"), share(gap <= 0.05).alias("within_5cm"), share(gap <= F.greatest(F.lit(0.01), 0.005 * F.col("other_len"))).alias("within_gate"),
    )


def compare(cells: DataFrame, rooms: DataFrame, walls: DataFrame, pairs: DataFrame, save: Callable[[DataFrame], DataFrame], step: float = STEP, cell: float = CELL) -> dict[str, DataFrame]:
    """What two walks of one place agree on: the alignment, rooms, walls and their differences, by pair of captures."""
    found = save(align(cells, pairs, step))
    rooms = save(matched_rooms(rooms, found))
    lines = save(same_lines(walls, found, rooms, cell))
    return {"alignment": found, "rooms": rooms, "walls": lines, "summary": repeatability(lines)}
