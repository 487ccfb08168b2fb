"""Quality of sorted units: missed spikes, refractory statistics, composite scores, and responses to stimuli.

A correlogram or a histogram of a unit is a short array, made by an aggregate that
combines before it shuffles; what is computed from it are array expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrellis.functions import trains as T

#: Fixed values of the published error function (Abramowitz and Stegun 7.1.26).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def erf(x: Column) -> Column:
    """The error function, to 1.5e-7."""
    t = 1 / (1 + F.abs(x) * _ERF_P)
    series = F.lit(0.0)
    for a in reversed(_ERF):
        series = (series + a) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def _bins(counts: DataFrame, keys: list[str], at: Column, bins: int) -> DataFrame:
    """keys and ``h``: n of bins 0 to bins - 1 as an array, empty bins included."""
    held = F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col("n"))))
    return counts.groupBy(*keys).agg(held.alias("m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("h"))


def amplitude_cutoff(spikes: DataFrame, bins: int = 100, smoothing: float = 3.0, least_per_bin: float = 5.0) -> DataFrame:
    """unit, cutoff: share of spikes estimated to lie below the threshold, 0.5 at most; NaN with too few spikes.

    The histogram of |amp| from its least to its largest value is smoothed by a Gaussian
    and cut to whole counts; what lies beyond the last bin that is as high as the first
    one stands for what is missing. Null amplitudes take no part.
    """
    x = spikes.where(F.col("amp").isNotNull()).select("unit", F.abs("amp").cast("double").alias("x"))
    ends = x.groupBy("unit").agg(F.count(F.lit(1)).alias("all"), F.min("x").alias("a"), F.max("x").alias("b"))
    same = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    ends = ends.select("unit", "all", (F.col("a") - same).alias("a"), (F.col("b") + same).alias("b"))
    edge = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / bins
    guess = F.least(F.floor((F.col("x") - F.col("a")) * (bins / (F.col("b") - F.col("a")))), F.lit(bins - 1))
    # rounding may put a value on the wrong side of an edge
    i = F.col("i")
    at = F.when((F.col("x") < edge(i)) & (i > 0), i - 1).when((i + 1 < bins) & (F.col("x") >= edge(i + 1)), i + 1).otherwise(i)
    counts = x.join(ends, "unit").withColumn("i", guess).groupBy("unit", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    radius = int(4 * smoothing + 0.5)
    weights = [math.exp(-0.5 * k * k / (smoothing * smoothing)) for k in range(radius + 1)]
    whole = weights[0] + 2 * sum(weights[1:])
    w = [v / whole for v in weights]

    def smooth(h: Column) -> Column:
        get = lambda k: F.get(h, F.greatest(F.least(k, F.lit(bins - 1)), F.lit(0)))
        kernel = F.array(*[F.lit(v) for v in w[1:]])
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.floor(F.aggregate(F.transform(kernel, lambda v, j: (get(k + j + 1) + get(k - j - 1)) * v), get(k) * w[0], lambda s, v: s + v)))

    smoothed = _bins(counts, ["unit"], F.col("bin"), bins).select("unit", smooth(F.col("h")).alias("p"))
    last = F.array_max(F.transform("p", lambda v, k: F.when(v >= F.get("p", 0), k).otherwise(0)))
    beyond = smoothed.withColumn("g", last).select("unit", F.aggregate(F.slice("p", F.col("g") + 2, F.size("p")), F.lit(0).cast("long"), lambda s, v: s + v).alias("missed"))
    share = F.least(F.col("missed") / (F.col("all") + F.col("missed")), F.lit(0.5))
    return ends.join(beyond, "unit").select("unit", F.when(F.col("all") / bins < least_per_bin, float("nan")).otherwise(share).alias("cutoff"))


def refractory_stats(correlograms: DataFrame, half_bins: int, shoulder: int, keys: tuple[str, ...] = ("unit",), most: int = 10, ignored: int = 1) -> DataFrame:
    """keys, ratio, probability, baseline of correlograms (keys, lag in bins, n; empty bins may be left out).

    The baseline is the larger mean of the shoulders, the bins at least ``shoulder`` from the
    centre. Over central parts up to ``most`` bins, without the ``ignored`` ones: the smallest
    ratio of what is counted to what the baseline gives, and the smallest probability of so few.
    Without a baseline the ratio is infinite and the probability 1.
    """
    shoulder = min(max(shoulder, 1), half_bins)
    h = _bins(correlograms.where(F.abs("lag") <= half_bins), list(keys), F.col("lag") + half_bins, 2 * half_bins + 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    wide = half_bins - shoulder + 1
    baseline = F.greatest(total(F.slice("h", 1, wide)), total(F.slice("h", half_bins + shoulder + 1, wide))) / wide

    def part(k: Column) -> Column:
        # bins ignored..k on both sides, and the centre once if nothing is ignored
        inner = F.slice("h", half_bins - k + 1, 2 * k + 1)
        left_out = F.slice("h", half_bins - ignored + 2, max(2 * ignored - 1, 1))
        n = total(inner) - (total(left_out) if ignored else 0.0)
        rate = (2 * k + 1 - (2 * ignored - 1 if ignored else 0)) * F.col("baseline")
        return F.struct((n / rate).alias("ratio"), (0.5 * (1 + erf((n - rate) / F.sqrt(1e-10 + 2 * rate)))).alias("p"))

    there = h.withColumn("baseline", baseline)
    parts = F.when(F.col("baseline") > 0, F.transform(F.sequence(F.lit(ignored), F.lit(max(min(most, half_bins - 1), ignored))), part))
    found = there.withColumn("parts", parts)
    least = lambda name: F.array_min(F.transform("parts", lambda e: e[name]))
    return found.select(*keys, F.coalesce(least("ratio"), F.lit(float("inf"))).alias("ratio"), F.coalesce(F.least(least("p"), F.lit(1.0)), F.lit(1.0)).alias("probability"), "baseline")


def is_refractory(stats: DataFrame, ratio: float, probability: float) -> DataFrame:
    """stats with ``refractory``: both numbers are below what is given (0.2 and 0.2 of one train, 0.25 and 0.05 of two)."""
    return stats.withColumn("refractory", (F.col("ratio") < ratio) & (F.col("probability") < probability))


def _unit(x: Column) -> Column:
    """0 to 1; 0 for what isn't finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def composite(contamination: Column, presence: Column, cutoff: Column, rate: Column, firing_range: Column, snr: Column, most_hz: float = 200.0, middle_snr: float = 4.0) -> Column:
    """struct(type_1, type_2, firing_rate, snr, score) of a unit; the score is their product. What isn't finite counts 0."""
    below = lambda x, mid: 1 / (1 + F.exp(x - mid))
    type_1, type_2 = _unit(1 - contamination), _unit(_unit(presence) * _unit(1 - cutoff))
    fast, clear = _unit(below(rate, most_hz) * below(firing_range, most_hz)), _unit(1 - below(snr, middle_snr))
    # an infinite signal to noise isn't a number either, though its logistic is
    clear = F.when(F.abs(snr) < float("inf"), clear).otherwise(0.0)
    return F.struct(type_1.alias("type_1"), type_2.alias("type_2"), fast.alias("firing_rate"), clear.alias("snr"), (type_1 * type_2 * fast * clear).alias("score"))


def sort_score(scores: DataFrame) -> DataFrame:
    """One row, score: the mean of the units' scores, null without units."""
    return scores.agg(F.avg("score").alias("score"))


def evoked(average: DataFrame, rate: float, start_ms: float, stop_ms: float, sigma: float, least_sd: float = 1e-6) -> DataFrame:
    """ch, onset_ms, peak_to_peak, rms, area of the response from start to stop in averages (ch, offset in samples, mean).

    The baseline is what lies before the stimulus; the onset is the first sample of the response
    further from its mean than sigma of its deviations (population, ``least_sd`` at least), null
    without one. Without samples of the response all are null.
    """
    t = F.col("offset") * (1000.0 / rate)
    before = F.when(F.col("offset") < 0, F.col("mean"))
    base = average.groupBy("ch").agg(F.avg(before).alias("m"), F.greatest(F.stddev_pop(before), F.lit(least_sd)).alias("sd"))
    v = F.col("mean") - F.coalesce("m", F.lit(0.0))
    inside = average.join(base, "ch").select("ch", t.alias("t"), v.alias("v"), (F.abs(v) > F.col("sd") * sigma).alias("on"), ((t >= start_ms) & (t <= stop_ms)).alias("within"))
    of = lambda x: F.when(F.col("within"), x)
    x = F.col("v")
    return inside.groupBy("ch").agg(
        F.min(F.when(F.col("within") & F.col("on"), F.col("t"))).alias("onset_ms"),
        (F.max(of(x)) - F.min(of(x))).alias("peak_to_peak"),
        F.sqrt(F.avg(of(x * x))).alias("rms"),
        (F.sum(of(F.abs(x))) * (1000.0 / rate)).alias("area"),
    )


def train_refractory(trains: DataFrame, bin_samples: int, half_bins: int, shoulder: int, ratio: float = 0.2, probability: float = 0.2) -> DataFrame:
    """unit, ratio, probability, baseline, refractory of each unit's autocorrelogram; a unit without pairs has no baseline."""
    got = refractory_stats(T.autocorrelogram(trains, bin_samples, half_bins), half_bins, shoulder)
    every = trains.select("unit").distinct().join(got, "unit", "left")
    filled = every.select("unit", F.coalesce("ratio", F.lit(float("inf"))).alias("ratio"), F.coalesce("probability", F.lit(1.0)).alias("probability"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"))
    return is_refractory(filled, ratio, probability)
