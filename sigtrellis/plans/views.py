"""Multi-resolution views: a pyramid of minima and maxima, each level made from the one below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(signal: DataFrame, bucket: int) -> DataFrame:
    """ch, bucket, lo, hi; NaN and null don't count, and buckets without values are left out."""
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    return signal.groupBy("ch", F.floor(F.col("s") / bucket).alias("bucket")).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where(F.col("lo").isNotNull())


def pyramid(signal: DataFrame, base: int = 64, levels: int = 4) -> DataFrame:
    """ch, level, bucket, lo, hi with buckets of base * 2^level samples. Samples are read once."""
    low = envelope(signal, base).select("ch", F.lit(0).alias("level"), "bucket", "lo", "hi")
    every = low.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return every.groupBy("ch", F.col("up").alias("level"), F.floor(F.col("bucket") / F.pow(F.lit(2), F.col("up"))).alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def level_for(samples: int, columns: int, base: int, levels: int) -> int | None:
    """The coarsest level with no more than a bucket for each column; None asks for raw samples."""
    fit = [k for k in range(levels) if base * 2**k * columns <= samples]
    return max(fit) if fit else None


def columns(signal: DataFrame, start: int, length: int, width: int) -> DataFrame:
    """ch, col, lo, hi of a view with so many columns over [start, start + length)."""
    inside = signal.where((F.col("s") >= start) & (F.col("s") < start + length))
    col = F.floor(((F.col("s") - start + 1) * width - 1) / length).cast("int")
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    return inside.groupBy("ch", col.alias("col")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def mean_range(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("ch").agg(F.avg(F.col("hi") - F.col("lo")).alias("mean_range"))
