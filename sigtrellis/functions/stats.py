"""Statistics per channel: aggregates with map-side combining, and exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the quartile of the normal distribution that scales medians to deviations.
NORMAL_QUARTILE = 0.67448975


def _at(v: Column, k: Column) -> Column:
    return F.get(F.sort_array(F.collect_list(v)), k.cast("int"))


def noise(v: Column) -> Column:
    """Upper median of magnitudes over the normal quartile."""
    return _at(F.abs(v), F.floor(F.count(v) / 2)) / NORMAL_QUARTILE


def nearest_rank(v: Column, q: float) -> Column:
    """The value at rank round((n - 1) q)."""
    return _at(v, F.round((F.count(v) - 1) * q))


def iqr(v: Column) -> Column:
    """Order statistic 3n/4 less order statistic n/4."""
    return _at(v, F.floor(F.count(v) * 3 / 4)) - _at(v, F.floor(F.count(v) / 4))


def kth(signal: DataFrame, k: int, channel: str = "ch") -> DataFrame:
    """The k-th smallest value (from 0) of each channel, by rank over a sort that may spill, for channels too long to collect."""
    w = Window.partitionBy(channel).orderBy("v", "s")
    return signal.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k + 1).select(channel, "v")


def summary(signal: DataFrame, channel: str = "ch") -> DataFrame:
    """n, mean, population deviation, rms noise, peak to peak and standard error of each channel."""
    n = F.count("v")
    return signal.groupBy(channel).agg(
        n.alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("peak_to_peak"), (F.stddev_samp("v") / F.sqrt(n)).alias("standard_error")
    )


def order_statistics(signal: DataFrame, channel: str = "ch") -> DataFrame:
    """Noise, interquartile range, nearest-rank 90 % and median of each channel."""
    v = F.col("v")
    return signal.groupBy(channel).agg(noise(v).alias("noise"), iqr(v).alias("iqr"), nearest_rank(v, 0.9).alias("p90"), F.percentile(v, 0.5).alias("median"))


def mad(signal: DataFrame, channel: str = "ch") -> DataFrame:
    """Median of the deviations from the median (means of the middle two)."""
    middle = signal.groupBy(channel).agg(F.percentile("v", 0.5).alias("_m"))
    return signal.join(middle, channel).groupBy(channel).agg(F.percentile(F.abs(F.col("v") - F.col("_m")), 0.5).alias("mad"))


def trimmed_deviation(signal: DataFrame, k: float = 3.0, channel: str = "ch", rounds: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """Deviation after values beyond k deviations of the mean went, again until it stays. One aggregate per round; a row per channel is kept."""
    moments = lambda d: d.groupBy(channel).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_d"))
    now = moments(signal)
    for _ in range(rounds):
        kept = signal.join(now, channel).where(F.abs(F.col("v") - F.col("_m")) <= k * F.col("_d"))
        new = moments(kept).select(channel, F.col("_m").alias("_m2"), F.col("_d").alias("_d2"))
        both = now.join(new, channel).persist()
        # a count, so that every partition of the kept table is computed once
        moved = both.agg(F.count_if(F.abs(F.col("_d") - F.col("_d2")) > tolerance * F.col("_d"))).first()[0]
        now = both.select(channel, F.col("_m2").alias("_m"), F.col("_d2").alias("_d"))
        if not moved:
            break
    return now.select(channel, F.col("_d").alias("deviation"))


def histogram(signal: DataFrame, low: float, high: float, bins: int, channel: str = "ch") -> DataFrame:
    """Counts in equal bins, empty ones too; the value high counts in the last, others outside don't."""
    at = F.least(F.floor((F.col("v") - low) * bins / (high - low)), F.lit(bins - 1))
    inside = signal.where((F.col("v") >= low) & (F.col("v") <= high) & ~F.isnan("v"))
    counts = inside.groupBy(channel, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = signal.select(channel).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [channel, "bin"], "left").select(channel, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def cross_correlation(frames: DataFrame, a: int, b: int, lags: int) -> DataFrame:
    """Sum over samples of channel a at s times channel b at s + lag, for lags within +-lags. One equi-join on the sample."""
    x = frames.select("s", F.get("v", a).alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("t", F.col("s") + F.col("lag"))
    y = frames.select(F.col("s").alias("t"), F.get("v", b).alias("y"))
    return x.join(y, "t").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("r"))


def covariance(frames: DataFrame, channels: int, centred: bool = True) -> DataFrame:
    """i, j, c for i <= j: second moments of a frame's channels. Products are summed per task before the shuffle."""
    i = F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))
    left = frames.withColumn("i", i)
    pairs = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(channels - 1)))).select("i", "j", F.get("v", F.col("i")).alias("x"), F.get("v", F.col("j")).alias("y"))
    value = F.covar_pop("x", "y") if centred else F.avg(F.col("x") * F.col("y"))
    return pairs.groupBy("i", "j").agg(value.alias("c"))


def element_moments(rows: DataFrame, key: str, values: str = "w") -> DataFrame:
    """Mean, deviation (ddof 1) and standard error at each place of a group's arrays: templates of snippets."""
    long = rows.select(key, F.posexplode(values).alias("place", "x"))
    return long.groupBy(key, "place").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se"))


def bin_centres(low: float, high: float, bins: int) -> list[float]:
    """The middles of equal bins."""
    return [low + (high - low) * (i + 0.5) / bins for i in range(bins)]


def peak_lag(correlation: DataFrame) -> DataFrame:
    """lag, r, exact: the lag of the largest r (the least of equal ones), and the top of the parabola through it and its neighbours."""
    c = correlation.select(F.col("lag").cast("int").alias("lag"), "r")
    top = c.agg(F.max(F.struct("r", (-F.col("lag")).alias("at"))).alias("m")).select((-F.col("m.at")).alias("lag"), F.col("m.r").alias("r"))  # one row
    near = c.join(F.broadcast(top.select(F.col("lag").alias("_top"))), F.abs(F.col("lag") - F.col("_top")) == 1)
    sides = near.agg(F.max(F.when(F.col("lag") < F.col("_top"), F.col("r"))).alias("a"), F.max(F.when(F.col("lag") > F.col("_top"), F.col("r"))).alias("b"))
    bend = F.col("a") - 2 * F.col("r") + F.col("b")
    return top.crossJoin(F.broadcast(sides)).select("lag", "r", F.coalesce(F.col("lag") + F.when(bend != 0, (F.col("a") - F.col("b")) / (2 * bend)), F.col("lag").cast("double")).alias("exact"))
