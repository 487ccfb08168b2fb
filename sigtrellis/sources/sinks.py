"""Sinks: tables, event files, raw exports, and the record of a run beside them."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an event file, in order.
EVENT_COLUMNS = ("channel", "channel_name", "onset_sample", "offset_sample", "peak_sample", "peak_value", "onset_s", "offset_s", "duration_s")


def event_table(events: DataFrame, rate: float, names: dict[int, str] | None = None) -> DataFrame:
    """The columns of an event file from ch, onset, offset, peak_sample, peak_value."""
    name = F.lit(None).cast("string")
    if names:
        name = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("ch"))
    return events.select(
        F.col("ch").alias("channel"),
        F.coalesce(name, F.concat(F.lit("ch"), F.col("ch").cast("string"))).alias("channel_name"),
        F.col("onset").alias("onset_sample"),
        F.col("offset").alias("offset_sample"),
        "peak_sample",
        "peak_value",
        (F.col("onset") / rate).alias("onset_s"),
        (F.col("offset") / rate).alias("offset_s"),
        ((F.col("offset") - F.col("onset")) / rate).alias("duration_s"),
    )


def write_events(events: DataFrame, path: str) -> None:
    """CSV with a header if the path ends in .csv, Parquet otherwise."""
    if path.endswith(".csv"):
        events.write.mode("overwrite").csv(path, header=True)
    else:
        events.write.mode("overwrite").parquet(path)


def write_signal(signal: DataFrame, path: str, block: int = 1 << 16, compression: str = "zstd") -> None:
    """A long signal as Parquet, partitioned by blocks of samples so that a range reads few files."""
    cut = signal.withColumn("blk", F.floor(F.col("s") / block))
    cut.repartition("blk").sortWithinPartitions("ch", "s").write.mode("overwrite").option("compression", compression).partitionBy("blk").parquet(path)


def is_complete(signal: DataFrame, channels: int, samples: int) -> bool:
    """Whether every channel has every sample once."""
    got = signal.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.max("ch").alias("c")).first()
    return got.n == channels * samples and got.a == 0 and got.b == samples - 1 and got.c == channels - 1


def write_raw(signal: DataFrame, path: str, channels: int, rate: float) -> int:
    """float32 frames in order of time with a sidecar, streamed through the driver partition by partition; returns the samples."""
    frames = signal.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("a")).select("s", F.transform("a", lambda e: e["v"]).alias("v")).orderBy("s")
    n = 0
    with open(path, "wb") as f:
        for row in frames.toLocalIterator(prefetchPartitions=True):
            f.write(np.asarray(row.v, "<f4").tobytes())
            n += 1
    with open(f"{path}.meta", "w") as f:
        json.dump({"channels": channels, "rate": rate, "format": "f32", "samples": n}, f)
    return n


def record(path: str, spec: dict, **facts) -> None:
    """<path>.pipeline.json has the spec that ran, <path>.run.json when and with what outcome."""
    with open(f"{path}.pipeline.json", "w") as f:
        json.dump(spec, f, indent=1, sort_keys=True)
    with open(f"{path}.run.json", "w") as f:
        json.dump({"finished": time.time(), **facts}, f, indent=1, sort_keys=True)
