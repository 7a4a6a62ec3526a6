"""Point clouds as binary PLY files, for viewers."""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def header(n: int) -> bytes:
    return (f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property float {a}\n" for a in "xyz") + "end_header\n").encode("ascii")


def write(points: DataFrame, path: str, most: int = 1_500_000) -> int:
    """Points x, y, z of one capture as a file; the number written.

    A viewer's file holds ``most`` points at most; of a larger cloud those with the smallest hashes,
    so that it is the same again. Rows with a null are left out.
    """
    d = points.select(*[F.col(a).cast("float") for a in "xyz"]).dropna()
    table = d.orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z").limit(most).toArrow()
    xyz = np.column_stack([table.column(a).to_numpy() for a in "xyz"]).astype("<f4")
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(at) as out:
        out.write(header(len(xyz)))
        out.write(xyz.tobytes())
    return len(xyz)


def read(path: str) -> np.ndarray:
    """The points of such a file."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    data = fs.open_input_file(at).read()
    head, _, body = data.partition(b"end_header\n")
    n = int(head.split(b"element vertex ")[1].split(b"\n")[0])
    return np.frombuffer(body, "<f4", 3 * n).reshape(-1, 3)
