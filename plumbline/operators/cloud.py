"""Point clouds: filters, projection, rigid motion and voxel reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: str | Column, size: float) -> Column:
    """Number of the cell of width ``size`` that holds x; exact halves go up."""
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(size)).cast("long")


def voxel_centroids(points: DataFrame, sizes: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean point and count of each voxel; partial sums are made before the shuffle."""
    cells = [cell(a, s).alias(f"i{a}") for a, s in sizes.items()]
    means = [F.round(F.avg(F.col(a).cast("double")), 6).alias(f"m{a}") for a in sizes]
    return points.groupBy(*keys, *cells).agg(F.count("*").alias("n"), *means)


def confident(pixels: DataFrame, near: float = 0.3, far: float = 4.0, least: int = 2) -> DataFrame:
    return pixels.where((F.col("conf") >= least) & F.col("z").between(near, far))


def back_project(pixels: DataFrame) -> DataFrame:
    """Camera-frame points of pixels (u, v, z, fx, fy, cx, cy) by the pinhole model."""
    z = F.col("z")
    return pixels.withColumns({"cam_x": (F.col("u") - F.col("cx")) * z / F.col("fx"), "cam_y": (F.col("v") - F.col("cy")) * z / F.col("fy"), "cam_z": z})


def rotate(points: DataFrame, q: tuple[str, str, str, str] = ("qx", "qy", "qz", "qw"), p: tuple[str, str, str] = ("cam_x", "cam_y", "cam_z")) -> DataFrame:
    """World points x, y, z: quaternion rotation of p, then the pose's position px, py, pz."""
    x, y, z, w = map(F.col, q)
    a, b, c = map(F.col, p)
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return points.withColumns({
        "x": a + w * tx + (y * tz - z * ty) + F.col("px"),
        "y": b + w * ty + (z * tx - x * tz) + F.col("py"),
        "z": c + w * tz + (x * ty - y * tx) + F.col("pz"),
    })


def shift_chunks(points: DataFrame, shifts: DataFrame) -> DataFrame:
    """Drift correction: each chunk's points turned by theta and moved by (dx, dz). A chunk without a shift stays."""
    d = points.join(F.broadcast(shifts), "chunk", "left")  # one row a chunk: the walk is cut into 20
    t, x, z = F.coalesce("theta", F.lit(0.0)), F.col("x"), F.col("z")
    return d.withColumns({
        "x": F.cos(t) * x - F.sin(t) * z + F.coalesce("dx", F.lit(0.0)),
        "z": F.sin(t) * x + F.cos(t) * z + F.coalesce("dz", F.lit(0.0)),
    }).drop("theta", "dx", "dz")
