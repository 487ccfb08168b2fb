"""Live chains on Structured Streaming: state is carried from batch to batch, so the result is that of the batch operators.

Streams are rows ch, s, v that arrive in order of s within a channel and batch. Rows
at or before the last sample of a channel are late and dropped, and counted in the
state; a gap resets a filter to rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sigtrellis.functions import design

LIVE_SCHEMA = "ch int, s long, v double"


def _fresh(parts: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    rows = pd.concat(list(parts)).sort_values("s", kind="stable")
    return rows[rows["s"] > last].drop_duplicates("s")


def filtered(stream: DataFrame, sections: np.ndarray) -> DataFrame:
    """Causal recursive filter; state: the last sample and two numbers a section."""
    size = 2 * len(sections)

    def step(key, parts, state):
        last, z = (state.get[0], np.array(state.get[1])) if state.exists else (-1, np.zeros(size))
        rows = _fresh(parts, last)
        if not len(rows):
            return
        s, x, y = rows["s"].to_numpy(), rows["v"].to_numpy(), []
        for run in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s) != 1) + 1):
            if s[run[0]] != last + 1:
                z = np.zeros(size)
            out, after = design.sosfilt(sections, x[run], z.reshape(-1, 2))
            z, last = after.ravel(), int(s[run[-1]])
            y.append(out)
        state.update((last, z.tolist()))
        yield pd.DataFrame({"ch": np.full(len(s), key[0]), "s": s, "v": np.concatenate(y)})

    return stream.groupBy("ch").applyInPandasWithState(step, LIVE_SCHEMA, "last long, z array<double>", "append", GroupStateTimeout.NoTimeout)


def crossings(stream: DataFrame, level: float, release: float | None = None, min_duration: int = 0, refractory: int = 0) -> DataFrame:
    """Closed crossings as they end; state: the open event, the value before and when the next may start."""
    release = level if release is None else release
    out = "ch int, onset long, offset long, peak_sample long, peak_value double"
    kept = "last long, before double, onset long, peak_sample long, peak_value double, ready long"

    def step(key, parts, state):
        last, before, onset, at, top, ready = state.get if state.exists else (-1, float("nan"), None, None, None, -(2**62))
        done = []
        rows = _fresh(parts, last)
        for s, v in zip(rows["s"].tolist(), rows["v"].tolist()):
            up, down = before < level <= v, before >= release > v
            if onset is not None and down and not up:
                if s - onset >= min_duration:
                    done.append((key[0], onset, s, at, top))
                    ready = s + refractory
                onset = None
            elif onset is not None:
                if v > top:
                    at, top = s, v
            elif up and s >= ready:
                onset, at, top = s, s, v
            last, before = s, v
        state.update((last, before, onset, at, top, ready))
        yield pd.DataFrame(done, columns=["ch", "onset", "offset", "peak_sample", "peak_value"])

    return stream.groupBy("ch").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def overview(stream: DataFrame, bucket: int) -> DataFrame:
    """Minima and maxima of buckets, updated as samples arrive."""
    return stream.groupBy("ch", F.floor(F.col("s") / bucket).alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def counted(stream: DataFrame, time: str, width: str, late: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Events per window of event time, with a watermark for late ones."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w).agg(F.count(F.lit(1)).alias("n"))


def tap(df: DataFrame, name: str, mode: str = "append"):
    """A named in-memory table of a live output."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode)


def clock_offset(pings: DataFrame) -> DataFrame:
    """Offset of a remote clock: that of the exchange with the shortest round trip. pings: sent, remote, received."""
    rtt = F.col("received") - F.col("sent")
    return pings.select((F.col("remote") - (F.col("sent") + F.col("received")) / 2).alias("offset"), rtt.alias("rtt")).agg(F.min_by("offset", "rtt").alias("offset"), F.min("rtt").alias("rtt"))
