"""Captures on disk as tables: walks of a depth camera, stills by room, clips, and their cache keys.

Roots may be globs, so that one read covers many captures; each row names its capture, the
folder it came from. Files are listed and read by Spark, pixels are decoded in batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Columns that odometry.csv must have.
REQUIRED = ["timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw"]
INTRINSICS = ["fx", "fy", "cx", "cy"]
#: Diagonal of a 35 mm film picture, in millimetres.
FILM_DIAGONAL = 43.267
#: Focal length, as for 35 mm film, of a still that names none.
DEFAULT_FOCAL = 24.0
IMAGES = ["jpg", "jpeg", "png", "heic"]


def frames(spark: SparkSession, root: str, depth_size: tuple[int, int] = (256, 192), rgb_size: tuple[int, int] | None = None) -> DataFrame:
    """One row a frame: capture, idx, frame, ts, position, quaternion and intrinsics in depth pixels.

    Intrinsics come from each row, else from the capture's camera_matrix.csv. They are in
    pixels of the colour picture where ``rgb_size`` is given and are scaled to the depth's.
    A number that cannot be read is null. A missing column is an error.
    """
    d = spark.read.csv(f"{root}/odometry.csv", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    d = d.toDF(*[c.strip() for c in d.columns])
    missing = [c for c in REQUIRED if c not in d.columns]
    if missing:
        raise ValueError(f"odometry.csv lacks {', '.join(missing)}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)") if c in d.columns else F.lit(None).cast("double")
    d = d.select(
        capture_of(F.input_file_name(), "odometry.csv").alias("capture"), F.trim("frame").alias("frame"), number("timestamp").alias("ts"),
        *[number(c).alias(f"p{c}") for c in "xyz"], *[number(c).alias(c) for c in REQUIRED[5:]], *[number(c).alias(c) for c in INTRINSICS],
    )
    matrix = camera_matrices(spark, root)
    if matrix is not None:
        d = d.join(matrix, "capture", "left").withColumns({c: F.coalesce(c, f"m_{c}") for c in INTRINSICS}).drop(*[f"m_{c}" for c in INTRINSICS])
    if rgb_size:
        sx, sy = depth_size[0] / rgb_size[0], depth_size[1] / rgb_size[1]
        d = d.withColumns({c: F.col(c) * (sx if c.endswith("x") else sy) for c in INTRINSICS})
    return d.withColumn("idx", F.row_number().over(W.partitionBy("capture").orderBy("ts", "frame")) - 1)


def capture_of(path: Column, file: str) -> Column:
    return F.regexp_extract(path, r"([^/]+)/" + file.replace(".", r"\.") + "$", 1)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def camera_matrices(spark: SparkSession, root: str) -> DataFrame | None:
    """Intrinsics of each capture's 3 by 3 matrix, as m_fx and so on; None where no capture has one."""
    if not _exists(spark, f"{root}/camera_matrix.csv"):
        return None
    d = spark.read.text(f"{root}/camera_matrix.csv", wholetext=True)
    cell = F.filter(F.split("value", r"[,\s]+"), lambda v: v != "")
    d = d.select(capture_of(F.input_file_name(), "camera_matrix.csv").alias("capture"), F.transform(cell, lambda v: v.try_cast("double")).alias("m"))
    return d.select("capture", *[F.get("m", F.lit(i)).alias(f"m_{c}") for c, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5))])


def chunked(frames: DataFrame, target: int = 1200, chunks: int = 10) -> DataFrame:
    """Every stride-th frame, so that about ``target`` are left, cut into ``chunks`` runs of equal length."""
    n = F.count("*").over(W.partitionBy("capture"))
    d = frames.withColumn("__stride", F.greatest(F.lit(1), F.floor(n / target))).where("idx % __stride = 0").drop("__stride")
    at = F.row_number().over(W.partitionBy("capture").orderBy("idx")) - 1
    return d.withColumn("chunk", F.least(F.floor(at * chunks / n), F.lit(chunks - 1)).cast("int"))


def _files(spark: SparkSession, root: str, folder: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{root}/{folder}")
    parts = F.regexp_extract
    return d.select(parts("path", rf"([^/]+)/{folder}/[^/]+$", 1).alias("capture"), parts("path", r"([^/]+)\.png$", 1).alias("frame"), F.col("content").alias(folder))


PIXELS = "capture string, frame string, u int, v int, z double, conf int"


def depth_pixels(spark: SparkSession, root: str, frames: DataFrame, stride: int = 1) -> DataFrame:
    """Pixels of the depth pictures of ``frames`` in metres, with their confidence; no reading is null.

    The compressed pictures meet before they are decoded: files are shuffled, pixels are not.
    A frame without a depth picture is an error; one without a confidence picture has null there.
    """
    d = frames.select("capture", "frame").join(_files(spark, root, "depth"), ["capture", "frame"], "left")
    d = d.withColumn("depth", F.coalesce("depth", F.raise_error(F.concat(F.lit("no depth picture of frame "), "frame")).cast("binary")))
    if _exists(spark, f"{root}/confidence"):
        d = d.join(_files(spark, root, "confidence"), ["capture", "frame"], "left")
    else:
        d = d.withColumn("confidence", F.lit(None).cast("binary"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from plumbline.sources import png

        for batch in batches:
            for row in batch.itertuples(index=False):
                z = png.decode(bytes(row.depth))[::stride, ::stride].astype(float) / 1000
                v, u = np.indices(z.shape) * stride
                conf = None if row.confidence is None else png.decode(bytes(row.confidence))[::stride, ::stride].ravel().astype("int32")
                out = pd.DataFrame({"capture": row.capture, "frame": row.frame, "u": u.ravel(), "v": v.ravel(), "z": np.where(z > 0, z, np.nan).ravel()})
                out["conf"] = pd.array(conf, dtype="Int32") if conf is not None else pd.array([None] * len(out), dtype="Int32")
                yield out

    return d.select("capture", "frame", "depth", "confidence").mapInPandas(decode, PIXELS).withColumn("z", F.nanvl("z", F.lit(None).cast("double")))


def focal_px(f35: Column, width: Column, height: Column) -> Column:
    """Focal length in pixels from one as for 35 mm film, over the picture's diagonal."""
    return f35 * F.hypot(width, height) / F.lit(FILM_DIAGONAL)


def photos(spark: SparkSession, root: str) -> DataFrame:
    """One row a still: room, name, path and sha256. Rooms are folders below images/, or below the root, or the root."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(IMAGES + [i.upper() for i in IMAGES]) + "}").load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_extract("path", rf"{base}/(?:images/)?(.*)$", 1)
    room = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(base)
    return d.select(room.alias("room"), F.substring_index("path", "/", -1).alias("name"), "path", F.sha2("content", 256).alias("sha256"), "length")


def photo_sets(photos: DataFrame, decoded: DataFrame) -> DataFrame:
    """Rooms with their stills and flags; ``decoded`` has path, width, height and f35 of those that could be read.

    Stills that could not be read are left out and counted, a missing focal length takes the
    default, and both are flagged, as are focal lengths that differ within a room.
    """
    f35 = F.coalesce("f35", F.lit(DEFAULT_FOCAL))
    d = photos.join(decoded.select("path", "width", "height", "f35", F.lit(True).alias("read")), "path", "left")
    still = F.struct("name", "sha256", "width", "height", f35.alias("f35"), focal_px(f35, F.col("width"), F.col("height")).alias("f_px"))
    g = d.groupBy("room").agg(
        F.array_sort(F.collect_list(F.when(F.col("read"), still))).alias("stills"),
        F.count_if(F.col("read").isNull()).alias("unreadable"), F.count_if(F.col("read") & F.col("f35").isNull()).alias("unknown"), F.count_distinct(F.when(F.col("read"), f35)).alias("focals"),
    )
    flags = F.array_compact(F.array(
        F.when(F.col("unreadable") > 0, F.format_string("%d stills could not be read", "unreadable")),
        F.when(F.col("unknown") > 0, F.format_string("%d stills name no focal length; %s mm is taken", "unknown", F.lit(str(DEFAULT_FOCAL)))),
        F.when(F.col("focals") > 1, F.lit("focal lengths differ")),
    ))
    return g.select("room", "stills", flags.alias("flags"))


#: Lens facts in a clip's container.
LENS_KEYS = {
    "com.apple.quicktime.camera.focal_length.35mm_equivalent": "focal_35mm",
    "com.apple.quicktime.camera.lens_model": "lens_model",
    "com.apple.quicktime.model": "device_model",
}
#: Boxes that hold boxes on the way to the metadata.
CONTAINERS = {b"moov", b"trak", b"udta"}


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of the boxes of a QuickTime file; stops at one that does not fit."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield kind, body, stop
        start = stop


def _value(kind: int, raw: bytes):
    if kind == 1:
        return raw.decode("utf-8", "replace")
    if kind in (23, 24):
        return struct.unpack(">f" if kind == 23 else ">d", raw)[0]
    return int.from_bytes(raw, "big", signed=True) if kind in (21, 22, 65, 66, 67, 74) else None


def lens_facts(data: bytes) -> dict:
    """Focal length, lens and device that a clip's metadata name; what is absent or damaged is left out."""
    found: dict = {}

    def walk(start: int, end: int) -> None:
        names: list[str] = []
        for kind, a, z in boxes(data, start, end):
            if kind in CONTAINERS or kind == b"meta":
                walk(a, z)
            elif kind == b"keys":
                at = a + 8
                for _ in range(int.from_bytes(data[a + 4 : a + 8], "big")):
                    size = int.from_bytes(data[at : at + 4], "big")
                    if size < 8 or at + size > z:
                        break
                    names.append(data[at + 8 : at + size].decode("utf-8", "replace"))
                    at += size
            elif kind == b"ilst":
                for index, b, y in boxes(data, a, z):
                    number = int.from_bytes(index, "big")
                    for inner, c, x in boxes(data, b, y):
                        if inner == b"data" and 0 < number <= len(names) and names[number - 1] in LENS_KEYS:
                            try:
                                found.setdefault(LENS_KEYS[names[number - 1]], _value(int.from_bytes(data[c : c + 4], "big"), data[c + 8 : x]))
                            except struct.error:
                                pass

    walk(0, len(data))
    try:
        focal = float(found.get("focal_35mm"))
        found["focal_35mm"] = focal if focal > 0 else None
    except (TypeError, ValueError):
        found["focal_35mm"] = None
    return found


def clips(spark: SparkSession, root: str) -> DataFrame:
    """One row a clip: path and what its container says of the lens."""
    schema = T.StructType.fromDDL("path string, length long, focal_35mm double, lens_model string, device_model string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = [lens_facts(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], **{k: [f.get(k) for f in facts] for k in LENS_KEYS.values()}})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{mov,mp4,MOV,MP4}").load(root).select("path", "length", "content").mapInPandas(read, schema)


def detect_tier(spark: SparkSession, root: str) -> str:
    """lidar, video or photo, by what the folder holds; anything else is an error."""
    if _exists(spark, f"{root}/odometry.csv"):
        return "lidar"
    if root.lower().endswith((".mov", ".mp4")) or _exists(spark, f"{root}/*.{{mov,mp4,MOV,MP4}}"):
        return "video"
    if any(_exists(spark, f"{root}/{p}*.{{{','.join(IMAGES + [i.upper() for i in IMAGES])}}}") for p in ("", "*/", "images/*/")):
        return "photo"
    raise ValueError(f"{root} is no capture: it holds neither odometry.csv nor clips nor stills")


def cache_misses(requests: DataFrame, cache: DataFrame, content: str = "content", stamp: str = "") -> DataFrame:
    """Requests whose content and stamp the cache has no result for, each content once."""
    keyed = requests.withColumn("key", F.sha2(F.concat(F.col(content).cast("binary"), F.encode(F.lit(stamp), "utf-8")), 256))
    return keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
