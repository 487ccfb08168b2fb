"""Filters along time as window functions over a long signal.

Windows are partitioned by the channel columns and ordered by the sample, so every
filter of a chain shares one shuffle and one sort. Long impulse responses and
recursive filters are in ``blocks``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(channel: str | Sequence[str] = "ch", sample: str = "s") -> WindowSpec:
    keys = [channel] if isinstance(channel, str) else list(channel)
    return Window.partitionBy(*keys).orderBy(sample)


def fir(v: Column, taps: Sequence[float], w: WindowSpec, centred: bool = False) -> Column:
    """Sum of taps[k] * v[t - k], zeros outside; centred shifts by half the taps."""
    half = (len(taps) - 1) // 2 if centred else 0
    out = F.lit(0.0)
    for k, tap in enumerate(taps):
        shift = k - half
        at = v if shift == 0 else F.lag(v, shift).over(w) if shift > 0 else F.lead(v, -shift).over(w)
        out = out + F.coalesce(at, F.lit(0.0)) * float(tap)
    return out


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(v: Column, sigma: float, w: WindowSpec, truncate: float = 4.0) -> Column:
    """Gaussian smoothing with reflected ends (d c b a | a b c d | d c b a)."""
    k = gaussian_kernel(sigma, truncate)
    r = len(k) // 2
    frame = F.collect_list(v).over(w.rowsBetween(-r, r))
    place, count = F.row_number().over(w), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    weights = F.array(*[F.lit(float(x)) for x in k])
    first = F.greatest(place - r, F.lit(1))

    def tap(x: Column, i: Column) -> Column:
        at = place - r + i
        period = count * 2
        folded = F.pmod(at - 1, period)
        inside = F.when(folded < count, folded).otherwise(period - 1 - folded) + 1
        return x * F.get(frame, (inside - first).cast("int"))

    return F.aggregate(F.transform(weights, tap), F.lit(0.0), lambda s, x: s + x)


def running_median(v: Column, width: int, w: WindowSpec) -> Column:
    """Odd width of 31 at most; zeros outside the signal."""
    if width % 2 == 0 or not 1 <= width <= 31:
        raise ValueError("running median: the width has to be odd and 31 at most")
    values = F.array(*[F.coalesce(F.lag(v, -k).over(w) if k else v, F.lit(0.0)) for k in range(-(width // 2), width // 2 + 1)])
    return F.get(F.sort_array(values), width // 2)


def teager_kaiser(v: Column, w: WindowSpec) -> Column:
    """v[t]^2 - v[t-1] * v[t+1]; the sample beyond an end is the end itself."""
    return v * v - F.coalesce(F.lag(v).over(w), v) * F.coalesce(F.lead(v).over(w), v)


def nonlinear_energy(v: Column, w: WindowSpec) -> Column:
    """max(0, v[t]^2 - v[t-1] * v[t+1]); both ends copy their neighbour's."""
    inner = F.greatest(v * v - F.lag(v).over(w) * F.lead(v).over(w), F.lit(0.0))
    ahead, behind = F.lead(v).over(w), F.lag(v).over(w)
    first = F.greatest(ahead * ahead - v * F.lead(v, 2).over(w), F.lit(0.0))
    last = F.greatest(behind * behind - F.lag(v, 2).over(w) * v, F.lit(0.0))
    return F.when(behind.isNull() & ahead.isNull(), F.lit(0.0)).when(behind.isNull(), F.coalesce(first, F.lit(0.0))).when(ahead.isNull(), F.coalesce(last, F.lit(0.0))).otherwise(inner)


def blank(signal: DataFrame, threshold: float, block: int, channel: str = "ch") -> DataFrame:
    """Blocks of so many samples in which any channel reaches the threshold become zero on all channels."""
    cell = F.floor(F.col("s") / block)
    hot = signal.where(F.abs("v") >= threshold).select(cell.alias("_cell")).distinct().withColumn("_hot", F.lit(True))
    return signal.withColumn("_cell", cell).join(hot, "_cell", "left").withColumn("v", F.when(F.col("_hot"), 0.0).otherwise(F.col("v"))).drop("_cell", "_hot")


def delay(signal: DataFrame, delays: dict[int, int]) -> DataFrame:
    """Channels moved back by whole samples; samples without a source are zero."""
    w = over()
    out = F.lit(None).cast("double")
    for d in sorted(set(delays.values())):
        these = [c for c, x in delays.items() if x == d]
        at = F.lead("v", d).over(w) if d > 0 else F.lag("v", -d).over(w) if d < 0 else F.col("v")
        out = F.when(F.col("ch").isin(these), F.coalesce(at, F.lit(0.0))).otherwise(out)
    return signal.withColumn("v", F.when(F.col("ch").isin(list(delays)), out).otherwise(F.col("v")))
