"""Pointwise and cross-channel operators.

A frame is a row per sample with ``v``, an array with a value for each channel; a
long signal is a row per sample and channel (``ch``, ``s``, ``v``). Frame operators
touch one row only: no shuffle, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(v: Column, alpha: float, beta: float = 0.0) -> Column:
    return v * alpha + beta


def subtract_baseline(v: Column, baseline: float) -> Column:
    return v - baseline


def clamp(v: Column, low: float, high: float) -> Column:
    """Null and NaN stay as they are."""
    if low > high:
        raise ValueError(f"clamp: min {low} is above max {high}")
    return F.when(F.isnan(v), v).when(v < low, low).when(v > high, high).otherwise(v)


def rectify(v: Column) -> Column:
    return F.abs(v)


def square(v: Column) -> Column:
    return v * v


def sqrt(v: Column) -> Column:
    """Of what is above zero; zero otherwise."""
    return F.sqrt(F.when(v > 0, v).otherwise(0.0))


def log10(v: Column) -> Column:
    """Of the magnitude, 1e-12 at least."""
    return F.log10(F.when(F.abs(v) > 1e-12, F.abs(v)).otherwise(1e-12))


def total(v: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def median(v: Column) -> Column:
    """Of an array; the mean of the middle two if its size is even."""
    ordered = F.sort_array(v)
    n = F.size(v)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def average_reference(v: Column) -> Column:
    """Each channel less the mean of all channels of the sample."""
    return F.transform(F.array(total(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m))[0]


def median_reference(v: Column) -> Column:
    """Each channel less the median of all channels of the sample."""
    return F.transform(F.array(median(v)), lambda m: F.transform(v, lambda x: x - m))[0]


def reorder(v: Column, order: Sequence[int]) -> Column:
    """Channel i of the result is channel order[i]; channels that aren't named go."""
    if len(set(order)) != len(order):
        raise ValueError("reorder: a channel is used twice")
    return F.array(*[F.get(v, i) for i in order])


def crop(v: Column, start: int, length: int) -> Column:
    return F.slice(v, start + 1, length)


def grid_neighbours(rows: int, cols: int) -> list[list[int]]:
    """The orthogonal neighbours of each site of a grid, numbered by row."""
    return [[r * cols + c for r, c in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)) if 0 <= r < rows and 0 <= c < cols] for a in range(rows) for b in range(cols)]


def laplacian(v: Column, rows: int, cols: int) -> Column:
    """Each channel of a grid less the mean of its orthogonal neighbours."""
    around = F.array(*[F.array(*[F.lit(i) for i in near]) for near in grid_neighbours(rows, cols)])
    return F.transform(v, lambda x, i: x - F.aggregate(F.get(around, i), F.lit(0.0), lambda s, j: s + F.get(v, j)) / F.size(F.get(around, i)))


def nearest_laplacian_weights(sites: Sequence[Sequence[float]], k: int) -> list[list[float]]:
    """Rows of a spatial matrix: a site less its k nearest, weighted by inverse distance (1e-3 at least)."""
    out = []
    for i, p in enumerate(sites):
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, j) for j, q in enumerate(sites) if j != i)[:k]
        weights = {j: 1 / max(d, 1e-3) for d, j in near}
        whole = sum(weights.values()) or 1.0
        out.append([1.0 if j == i else -weights.get(j, 0.0) / whole for j in range(len(sites))])
    return out


def spatial(v: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """matrix times the frame. Rows with at most half their entries filled use those alone."""

    def row(weights: Sequence[float]) -> Column:
        used = [(j, w) for j, w in enumerate(weights) if w]
        if 2 * len(used) <= len(weights):
            out = F.lit(0.0)
            for j, w in used:
                out = out + F.get(v, j) * w
            return out
        return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return F.array(*[row(r) for r in matrix])


def to_long(frames: DataFrame, sample: str = "s", values: str = "v") -> DataFrame:
    """ch, s, v: a row for each sample and channel."""
    return frames.select(F.col(sample).alias("s"), F.posexplode(values).alias("ch", "v"))


def to_frames(signal: DataFrame, channels: int) -> DataFrame:
    """s, v: an array for each sample; channels that are missing there are null."""
    return signal.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("ch", "v"))).alias("m")).select("s", F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.try_element_at("m", i)).alias("v"))


def remap(signal: DataFrame, pairs: Sequence[tuple[int, int]], base: int = 0) -> DataFrame:
    """Long signal with channels renumbered by (from, to); channels that aren't named go.

    The targets have to be 0..n without a gap, and no source may be used twice.
    """
    source, target = [a - base for a, _ in pairs], [b - base for _, b in pairs]
    if sorted(target) != list(range(len(target))) or len(set(source)) != len(source) or min(source, default=0) < 0:
        raise ValueError("remap: targets must be 0..n once each, sources unique and not negative")
    moved = F.create_map(*[F.lit(x) for pair in zip(source, target) for x in pair])
    return signal.withColumn("ch", F.try_element_at(moved, F.col("ch"))).where(F.col("ch").isNotNull())


def merge(signals: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Long signals side by side; each comes with its number of channels."""
    out, first = None, 0
    for signal, channels in signals:
        part = signal.select((F.col("ch") + first).alias("ch"), "s", "v")
        out = part if out is None else out.unionByName(part)
        first += channels
    return out


def decode(stored: Column, gain: Column | float, offset: Column | float) -> Column:
    """Stored integers to values of the channel's unit."""
    return stored.cast("double") * gain + offset
