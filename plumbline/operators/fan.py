"""Free floor about one station: how far each direction is open, and the cells up to there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Degrees, points, a percentile, and metres.
BIN = 2.0
LEAST_POINTS = 20
NEAREST = 0.1
MARGIN = 0.3
BAND = (0.25, 2.05)
CELL = 0.05


def reaches(points: DataFrame, bin_: float = BIN, least: int = LEAST_POINTS, share: float = NEAREST, margin: float = MARGIN) -> DataFrame:
    """(capture, sector, n, reach): free way along each sector of ``bin_`` degrees, from the middle of the station.

    ``points`` has capture, x and z of points between floor and head height, with the station at the origin;
    sector k spans the azimuths from 180 degrees left of z on. The nearest tenth of a sector's points may be
    stray ones: the way ends ``margin`` before their percentile. Sectors with fewer than ``least``
    points, or without any way, have no row. Points with nulls take no part.
    """
    azimuth = F.degrees(F.atan2("x", "z"))
    d = points.where("x IS NOT NULL AND z IS NOT NULL").select("capture", F.floor((azimuth + 180) / bin_).cast("long").alias("sector"), F.hypot("x", "z").alias("r"))
    d = d.groupBy("capture", "sector").agg(F.count("*").alias("n"), (F.percentile("r", F.lit(share)) - margin).alias("reach"))
    return d.where((F.col("n") >= least) & (F.col("reach") > 0))


def fan(open_: DataFrame, stations: DataFrame, bin_: float = BIN, cell: float = CELL) -> DataFrame:
    """(capture, sector, step, x, z): the station itself, with a null sector, and a place every ``cell`` along each sector's middle.

    ``open_`` comes from ``reaches``; ``stations`` has capture. The last place lies short of the reach.
    """
    steps = F.ceil(F.round(F.col("reach") / cell, 9)).cast("long") - 1
    d = open_.withColumn("last", steps).where("last >= 1").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    a = F.radians((F.col("sector") + 0.5) * bin_ - 180)
    along = d.select("capture", "sector", "step", (F.sin(a) * F.col("step") * cell).alias("x"), (F.cos(a) * F.col("step") * cell).alias("z"))
    zero = F.lit(0.0)
    own = stations.select("capture").distinct().select("capture", F.lit(None).cast("long").alias("sector"), F.lit(0).cast("long").alias("step"), zero.alias("x"), zero.alias("z"))
    return along.union(own)


def of_cloud(points: DataFrame, stations: DataFrame) -> DataFrame:
    """The fan of each station from its points (capture, x, y, z) and (capture, floor): those between floor and head height count."""
    h = F.col("y") - F.col("floor")
    band = points.join(stations.select("capture", "floor"), "capture").where((h > BAND[0]) & (h < BAND[1]))
    return fan(reaches(band.select("capture", "x", "z")), stations)
