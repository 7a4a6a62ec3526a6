"""Streams of frames: the sharpest of each window, running weighted means, and a strip followed from frame to frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sharpest(frames: DataFrame, step: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """(clip, start, ts, frame, sharpness): the sharpest frame of each window of a clip, of equal ones the first.

    A window is given out once no frame as late as ``late`` can come; later ones are dropped.
    Null times and sharpness take no part. The same plan serves tables.
    """
    d = frames.where("ts IS NOT NULL AND sharpness IS NOT NULL").withWatermark("ts", late)
    best = F.max_by(F.struct("ts", "frame", "sharpness"), F.struct("sharpness", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("early"), (-F.col("frame")).alias("least")))
    d = d.groupBy("clip", F.window("ts", step).alias("w")).agg(best.alias("m"))
    return d.select("clip", F.col("w.start").alias("start"), "m.*")


def running_means(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, views, mean, var): weighted means of value so far; sums are all that is kept of a stream. For update mode."""
    w, v = F.col("weight"), F.col("value")
    d = samples.where("weight > 0 AND value IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("views"), F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"))
    m = F.col("wv") / F.col("w")
    return d.select(*keys, "views", m.alias("mean"), F.greatest(F.lit(0.0), F.col("wvv") / F.col("w") - m * m).alias("var"))


TRACK = "clip long, ts timestamp, x double, y double"
STATE = "x double, y double, misses int, done boolean, seen timestamp"


def follow(state: tuple, sightings: Iterable[tuple], max_misses: int, reach: float) -> tuple[tuple, list[tuple]]:
    """The state after the sightings (ts, x, y, length), in order of time, and the places taken.

    A frame's sightings share its time. The longest begins the track; then the nearest to the
    last place within ``reach`` goes on with it. A frame without one is a miss, and more than
    ``max_misses`` misses in a row end the track for good. Frames before the last one are too late.
    """
    x, y, misses, done, seen = state
    by_time: dict = {}
    for ts, px, py, length in sightings:
        by_time.setdefault(ts, []).extend([] if px is None or py is None or px != px or py != py else [(px, py, length or 0.0)])
    taken = []
    for ts in sorted(by_time):
        if done or (seen is not None and ts <= seen):
            continue
        seen, found = ts, by_time[ts]
        if x is not None:
            found = [f for f in found if (f[0] - x) ** 2 + (f[1] - y) ** 2 <= reach * reach]
            pick = min(found, key=lambda f: ((f[0] - x) ** 2 + (f[1] - y) ** 2, f), default=None)
        else:
            pick = max(found, key=lambda f: (f[2], -f[0], -f[1]), default=None)
        if pick is None:
            misses += x is not None
            done = misses > max_misses
        else:
            x, y, misses = pick[0], pick[1], 0
            taken.append((ts, x, y))
    return (x, y, misses, done, seen), taken


START = (None, None, 0, False, None)


def track(sightings: DataFrame, max_misses: int = 4, reach: float = 80.0, until: float | None = None, late: str = "10 seconds") -> DataFrame:
    """(clip, ts, x, y): each clip's strip followed through a stream or table of clip, ts, x, y, length.

    Rows of frames where nothing was seen have a null place. A stream keeps five values a clip. With ``until``
    sightings have ``started``, too, the same for all rows of a clip, and only frames up to that many seconds after it
    count; rows without a start take no part. A timer then deletes a clip's state once no frame as late as ``late``
    can come in time, so that a stream without end holds the clips of its last minutes alone. What comes later than that is dropped.
    """
    d = sightings.select("clip", F.col("ts").cast("timestamp").alias("ts"), "x", "y", "length", *([] if until is None else [F.col("started").cast("timestamp").alias("started")]))
    if until is not None:
        d = d.withColumn("ends", F.col("started") + F.make_dt_interval(secs=F.lit(float(until)))).where("ts <= ends").withColumn("ends", F.unix_millis("ends")).drop("started")
    columns = ["ts", "x", "y", "length"]
    rows = lambda g: g[columns].astype(object).where(g[columns].notna(), None).itertuples(index=False, name=None)
    if not sightings.isStreaming:
        def batch(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            _, taken = follow(START, rows(g), max_misses, reach)
            return pd.DataFrame([(key[0], *t) for t in taken], columns=["clip", "ts", "x", "y"])

        return d.groupBy("clip").applyInPandas(batch, TRACK)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(parts)
        kept = [r for g in parts for r in rows(g)]  # a clip's frames of one batch, ordered before they count
        new, taken = follow(state.get if state.exists else START, kept, max_misses, reach)
        ends = None if until is None else max(int(g["ends"].max()) for g in parts if len(g))
        if ends is None or ends > state.getCurrentWatermarkMs():
            state.update(new)
            if ends is not None:
                state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *t) for t in taken], columns=["clip", "ts", "x", "y"])

    if until is None:
        return d.groupBy("clip").applyInPandasWithState(step, TRACK, STATE, "append", GroupStateTimeout.NoTimeout)
    return d.withWatermark("ts", late).groupBy("clip").applyInPandasWithState(step, TRACK, STATE, "append", GroupStateTimeout.EventTimeTimeout)
