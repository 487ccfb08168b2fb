"""Metrics of point processes. A train is a row per spike: ``unit``, ``s`` (sample).

Pairs of spikes within a window come from cells of time: a spike looks in its own
cell and its neighbours, so the work follows the pairs that are near each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrellis.lineage import settled


def intervals(trains: DataFrame) -> DataFrame:
    """unit, s, isi: samples since the unit's spike before, without the first."""
    w = Window.partitionBy("unit").orderBy("s")
    return trains.select("unit", "s", (F.col("s") - F.lag("s").over(w)).alias("isi")).where(F.col("isi").isNotNull())


def isi_violations(trains: DataFrame, rate: float, total_s: float, threshold_s: float, min_s: float = 0.0) -> DataFrame:
    """unit, n, violations, ratio: intervals under the threshold, against what a rate of all spikes would give."""
    w = Window.partitionBy("unit").orderBy("s")
    seconds = F.col("s") / rate
    timed = trains.select("unit", (seconds - F.lag(seconds).over(w)).alias("d"))
    counts = timed.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("d") < threshold_s, 1)).alias("violations"))
    expected = 2 * F.col("n") * (threshold_s - min_s)
    return counts.withColumn("ratio", F.col("violations") / expected / (F.col("n") / total_s))


def isi_histogram(trains: DataFrame, rate: float, bin_s: float, max_s: float) -> DataFrame:
    """unit, bin, n of intervals below the maximum; empty bins are left out."""
    d = F.col("isi") / rate
    return intervals(trains).where(d < max_s).groupBy("unit", F.floor(d / bin_s).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def presence(trains: DataFrame, bin_samples: int, total_samples: int, least: int = 0) -> DataFrame:
    """unit, presence: share of bins with more than so many spikes; a spike at the last edge is in the last bin."""
    bins = total_samples // bin_samples
    at = F.when(F.col("s") == bins * bin_samples, bins - 1).otherwise(F.floor(F.col("s") / bin_samples))
    held = trains.select("unit", at.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("unit", "bin").agg(F.count(F.lit(1)).alias("n"))
    return trains.select("unit").distinct().join(held.where(F.col("n") > least).groupBy("unit").agg(F.count(F.lit(1)).alias("k")), "unit", "left").select("unit", (F.coalesce("k", F.lit(0)) / bins).alias("presence"))


def near_pairs(a: DataFrame, b: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a (s) and b (t) with |t - s| <= reach, and equal keys, by cells of time."""
    cell = lambda c: F.floor(c / (reach + 1))
    left = a.withColumn("_cell", F.explode(F.array(*[cell(F.col("s")) + d for d in (-1, 0, 1)])))
    right = b.withColumn("_cell", cell(F.col("t")))
    return left.join(right, ["_cell", *keys]).where(F.abs(F.col("t") - F.col("s")) <= reach).drop("_cell")


def refractory_pairs(trains: DataFrame, refractory: int) -> DataFrame:
    """unit, pairs: pairs of a unit's spikes no further apart, not only neighbours."""
    numbered = trains.withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy("s")))
    pairs = near_pairs(numbered, numbered.select("unit", F.col("s").alias("t"), F.col("i").alias("j")), refractory, ("unit",)).where(F.col("i") < F.col("j"))
    return trains.select("unit").distinct().join(pairs.groupBy("unit").agg(F.count(F.lit(1)).alias("pairs")), "unit", "left").select("unit", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def contamination(trains: DataFrame, total_samples: int, refractory: int, censored: int = 0) -> DataFrame:
    """unit, contamination: 1 - sqrt(1 - n_v (T - 2 N t_c) / (N^2 (t_r - t_c))), 1 where the root isn't real."""
    n = trains.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    inner = 1 - F.col("pairs") * (F.lit(float(total_samples)) - 2.0 * F.col("n") * censored) / (F.col("n") * F.col("n") * float(refractory - censored))
    return n.join(refractory_pairs(trains, refractory), "unit").select("unit", F.when(inner < 0, 1.0).otherwise(1 - F.sqrt(F.when(inner > 0, inner).otherwise(0.0))).alias("contamination"))


def autocorrelogram(trains: DataFrame, bin_samples: int, half_bins: int) -> DataFrame:
    """unit, lag (in bins, both signs), n: ordered pairs of a unit's spikes by the rounded lag."""
    reach = int(math.ceil((half_bins + 0.5) * bin_samples)) - 1
    numbered = trains.withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy("s")))
    pairs = near_pairs(numbered, numbered.select("unit", F.col("s").alias("t"), F.col("i").alias("j")), reach, ("unit",)).where(F.col("i") < F.col("j"))
    lag = F.least(F.floor((F.col("t") - F.col("s")) / bin_samples + 0.5), F.lit(half_bins)).cast("int")
    return pairs.select("unit", F.explode(F.array(lag, -lag)).alias("lag")).groupBy("unit", "lag").agg(F.count(F.lit(1)).alias("n"))


def crosscorrelogram(a: DataFrame, b: DataFrame, bin_samples: int, half_bins: int) -> DataFrame:
    """lag, n: pairs of spikes of two trains (s) by the rounded lag of the second after the first."""
    reach = int(math.ceil((half_bins + 0.5) * bin_samples)) - 1
    d = F.col("t") - F.col("s")
    lag = (F.sign(d) * F.floor(F.abs(d) / bin_samples + 0.5)).cast("int")
    return near_pairs(a.select("s"), b.select(F.col("s").alias("t")), reach).select(F.greatest(F.least(lag, F.lit(half_bins)), F.lit(-half_bins)).alias("lag")).groupBy("lag").agg(F.count(F.lit(1)).alias("n"))


def firing_rate(trains: DataFrame, bin_samples: int, total_samples: int, rate: float) -> DataFrame:
    """unit, bin, rate without gaps: spikes of each bin over its length in seconds."""
    bins = -(-total_samples // bin_samples)
    counts = trains.select("unit", F.floor(F.col("s") / bin_samples).cast("int").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("unit", "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = trains.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, ["unit", "bin"], "left").select("unit", "bin", (F.coalesce("n", F.lit(0)) / (bin_samples / rate)).alias("rate"))


def firing_range(rates: DataFrame) -> DataFrame:
    """unit, firing_range: 95 % less 5 % of the binned rates, interpolated."""
    return rates.groupBy("unit").agg((F.percentile("rate", 0.95) - F.percentile("rate", 0.05)).alias("firing_range"))


def raster(trains: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """unit, trial, offset: spikes in [event - before, event + after). events: trial, t."""
    reach = max(before, after)
    pairs = near_pairs(events.select("trial", F.col("t").alias("s")), trains.select("unit", F.col("s").alias("t")), reach)
    offset = F.col("t") - F.col("s")
    return pairs.where((offset >= -before) & (offset < after)).select("unit", "trial", offset.alias("offset"))


def psth(trains: DataFrame, events: DataFrame, before: int, after: int, bins: int, rate: float) -> DataFrame:
    """unit, bin, mean, se: firing rate around events over all trials, silent trials included."""
    width = (before + after) / bins
    at = F.least(F.floor((F.col("offset") + before) / width), F.lit(bins - 1)).cast("int")
    counts = raster(trains, events, before, after).groupBy("unit", "trial", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    trials = events.select("trial").distinct().agg(F.count(F.lit(1)).alias("trials"))
    sums = counts.groupBy("unit", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    k = F.col("trials")
    variance = (F.col("nn") - F.col("n") * F.col("n") / k) / (k - 1)
    hz = rate / width
    # one row, the number of trials
    return sums.crossJoin(F.broadcast(trials)).select("unit", "bin", (F.col("n") / k * hz).alias("mean"), (F.sqrt(F.greatest(variance, F.lit(0.0)) / k) * hz).alias("se"))


def triggered_average(signal: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """ch, offset, n, mean, std (ddof 1), se of a signal around events whose window it covers."""
    marked = signal.select("ch", F.col("s").alias("t"), "v")
    near = near_pairs(events.select("trial", F.col("t").alias("s")), marked, max(before, after))
    offset = F.col("t") - F.col("s")
    inside = near.where((offset >= -before) & (offset < after)).select("ch", "trial", offset.alias("offset"), "v")
    full = inside.groupBy("ch", "trial").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == before + after)
    return inside.join(full, ["ch", "trial"]).groupBy("ch", "offset").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"))


def quality(n: Column, snr: Column, isi_ratio: Column) -> Column:
    """Label of a unit by its spikes, signal to noise and interval violations."""
    finite = snr.isNotNull() & ~F.isnan(snr) & (F.abs(snr) < float("inf"))
    clean = isi_ratio.isNull() | F.isnan(isi_ratio) | (isi_ratio < 0.5)
    return F.when(n < 3, "noise").when(~finite, "unsorted").when(snr < 1.5, "noise").when(clean & (snr >= 3), "good").otherwise("mua")


def unit_order(units: DataFrame, column: str, descending: bool = False, label: str | None = None) -> DataFrame:
    """Unit table of one label, or all, by a column; nulls last either way, ties by index."""
    chosen = units if label is None else units.where(F.col("label") == label)
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return chosen.orderBy(key, "index")


def duplicate_spikes(trains: DataFrame, tolerance: int) -> DataFrame:
    """Trains without the spikes that follow a kept one within the tolerance. Folded per unit and burst: a longer gap starts anew."""
    w = Window.partitionBy("unit").orderBy("s")
    gap = F.coalesce((F.col("s") - F.lag("s").over(w) > tolerance).cast("int"), F.lit(1))
    runs = trains.select("unit", "s", gap.alias("_new")).withColumn("_run", F.sum("_new").over(w))
    rows = runs.groupBy("unit", "_run").agg(F.array_sort(F.collect_list("s")).alias("all"))
    empty = F.array().cast("array<bigint>")
    kept = F.aggregate("all", empty, lambda k, s: F.when((F.size(k) == 0) | (s - F.try_element_at(k, F.lit(-1)) > tolerance), F.concat(k, F.array(s))).otherwise(k))
    return rows.select("unit", F.explode(kept).alias("s"))


def match_trains(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """unit_a, unit_b, matches, agreement, precision, recall of every pair of units with spikes near each other.

    Spikes are matched one to one in order of time. A run of spikes without a gap
    beyond the tolerance is matched on its own, so a fold never sees a whole train.
    """
    pairs = near_pairs(a.select(F.col("unit").alias("unit_a"), "s"), b.select(F.col("unit").alias("unit_b"), F.col("s").alias("t")), tolerance)
    sides = pairs.select("unit_a", "unit_b", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(0).alias("side")), F.struct(F.col("t").alias("at"), F.lit(1).alias("side")))).alias("e")).distinct()
    w = Window.partitionBy("unit_a", "unit_b").orderBy("e")
    new = F.coalesce((F.col("e.at") - F.lag("e.at").over(w) > tolerance).cast("int"), F.lit(1))
    runs = sides.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("unit_a", "unit_b", "run").agg(F.array_sort(F.collect_list("e")).alias("all"))
    none = F.array().cast("array<bigint>")

    def step(state: Column, e: Column) -> Column:
        # spikes that wait are all of one side; those too old for e are passed by
        live = F.filter(state["waiting"], lambda t: e["at"] - t <= tolerance)
        other = state["side"] != e["side"]
        hit = other & (F.size(live) > 0)
        waiting = F.when(hit, F.slice(live, 2, F.greatest(F.size(live), F.lit(1)))).when(other, F.array(e["at"])).otherwise(F.concat(live, F.array(e["at"])))
        return F.struct(waiting.alias("waiting"), F.when(hit, state["side"]).otherwise(e["side"]).alias("side"), (state["n"] + hit.cast("int")).alias("n"))

    start = F.struct(none.alias("waiting"), F.lit(0).alias("side"), F.lit(0).alias("n"))
    matched = runs.select("unit_a", "unit_b", F.aggregate("all", start, step, lambda s: s["n"]).alias("n"))
    counts = matched.groupBy("unit_a", "unit_b").agg(F.sum("n").alias("matches"))
    size = lambda d, u, n: d.groupBy(F.col("unit").alias(u)).agg(F.count(F.lit(1)).alias(n))
    m, na, nb = F.col("matches"), F.col("na"), F.col("nb")
    return counts.join(size(a, "unit_a", "na"), "unit_a").join(size(b, "unit_b", "nb"), "unit_b").select("unit_a", "unit_b", "matches", (m / (na + nb - m)).alias("agreement"), (m / nb).alias("precision"), (m / na).alias("recall"))


def greedy_units(scores: DataFrame, least: float = 0.0) -> DataFrame:
    """One-to-one units by falling agreement. Takes every pair that is the best of both sides, again until every pair left is.

    Pairs that were taken stay and remain the best, for the others of their units go. A round starts from a settled
    table: plans that hold those of the rounds before, on both sides of a join, would grow threefold in each.
    """
    best = lambda u: F.row_number().over(Window.partitionBy(u).orderBy(F.desc("agreement"), "unit_a", "unit_b")) == 1
    taken = lambda u: F.max("top").over(Window.partitionBy(u))
    left = scores.where(F.col("agreement") > least).select("unit_a", "unit_b", "agreement")
    while True:
        ranked = left.withColumn("a", best("unit_a")).withColumn("top", F.col("a") & best("unit_b"))
        left = settled(ranked.withColumn("gone", taken("unit_b") | taken("unit_a")).where(F.col("top") | ~F.col("gone")).select("unit_a", "unit_b", "agreement", "top"))
        if left.where(~F.col("top")).isEmpty():
            return left.drop("top")


def as_of(rows: DataFrame, knots: DataFrame, value: str, key: str = "unit") -> DataFrame:
    """rows (key, s, ...) with ``value`` of the knot (key, s, value) at s or last before it, null before the first, by one shuffle and sort.

    Of knots of one key and place the largest value counts; rows at a knot's place see it.
    """
    names = [c for c in rows.columns if c not in (key, "s")]
    left = rows.select(key, "s", F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in names]).alias("_row"), F.lit(None).cast(knots.schema[value].dataType).alias("_value"))
    once = knots.where(F.col("s").isNotNull()).groupBy(key, "s").agg(F.max(value).alias("_value"))
    right = once.select(key, "s", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_value")
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy("s", "_side"))
    return left.unionByName(right).withColumn("_seen", seen).where(F.col("_side") == 1).select(key, "s", *[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_seen").alias(value))


def amplitude_histogram(trains: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """unit, bin, n of amplitudes (amp) from low to high; the last bin holds its upper edge, empty bins are left out."""
    at = F.when(F.col("amp") == high, bins - 1).otherwise(F.floor((F.col("amp") - low) / ((high - low) / bins)))
    return trains.where(F.col("amp").between(low, high)).groupBy("unit", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def without_small(labelled: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Rows of labels with at least so many rows; labels below zero are noise and stay."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= least) | (F.col(label) < 0)).select(label)
    return labelled.join(sizes, label, "left_semi")


def stride(rows: DataFrame, every: int, key: str = "unit") -> DataFrame:
    """Every so manieth row of a key in order of s, from the first."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("s"))
    return rows.withColumn("_at", at).where((F.col("_at") - 1) % every == 0).drop("_at")
