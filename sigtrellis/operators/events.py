"""Threshold crossings, peaks and the events made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crossings(signal: DataFrame, level: float, release: float | None = None, channel: str = "ch", min_duration: int = 0, refractory: int = 0, direction: str = "rising") -> DataFrame:
    """channel, onset, offset (null while open), peak_sample, peak_value of each crossing.

    An onset is a sample at or above the level after one below it, outside an event;
    an event ends at the first sample below the release after one at or above it. The
    first sample of a channel is never an onset. Events shorter than ``min_duration``
    go; after the offset of a kept event no event opens for ``refractory`` samples, but
    the next onset from then on does. ``falling`` is the same of the negated signal,
    levels and values as they are in the signal.
    """
    if direction not in ("rising", "falling"):
        raise ValueError("crossings: the direction is rising or falling")
    release = level if release is None else release
    sign = 1 if direction == "rising" else -1
    if sign * release > sign * level:
        raise ValueError("crossings: the release is past the level")
    w = Window.partitionBy(channel).orderBy("s")
    v, p = F.col("v") * sign, F.lag("v").over(w) * sign
    up, down = (p < sign * level) & (v >= sign * level), (p >= sign * release) & (v < sign * release)
    flagged = signal.select(channel, "s", "v", F.when(up, 1).when(down, 0).alias("flag"))
    if min_duration or refractory:
        marks = _kept(flagged.where(F.col("flag").isNotNull()), channel, min_duration, refractory)
        opened = flagged.join(marks.select(channel, F.col("onset").alias("s"), F.struct("onset", "offset").alias("mark")), [channel, "s"], "left")
        last = F.last("mark", ignorenulls=True).over(w)
        inside = opened.withColumn("event", last).where(F.col("event").isNotNull() & (F.col("event.offset").isNull() | (F.col("s") < F.col("event.offset"))))
        top = F.max(F.struct((F.col("v") * sign).alias("value"), (-F.col("s")).alias("at"))).alias("peak")
        found = inside.groupBy(channel, "event").agg(top).select(channel, "event.onset", "event.offset", "peak")
    else:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        held = flagged.withColumn("held", F.coalesce(F.last("flag", ignorenulls=True).over(before), F.lit(0)))
        turns = held.withColumn("island", F.sum(F.when((F.col("flag") == 1) & (F.col("held") == 0), 1).otherwise(0)).over(w))
        ends = (F.col("flag") == 0) & (F.col("held") == 1)
        open_ = (F.col("held") == 1) | (F.col("flag") == 1)
        # the sample that ends an event is past it
        found = turns.where((F.col("island") > 0) & open_).groupBy(channel, "island").agg(
            F.min("s").alias("onset"),
            F.min(F.when(ends, F.col("s"))).alias("offset"),
            F.max(F.when(~ends | F.col("flag").isNull(), F.struct((F.col("v") * sign).alias("value"), (-F.col("s")).alias("at")))).alias("peak"),
        )
    return found.select(channel, "onset", "offset", (-F.col("peak.at")).alias("peak_sample"), (F.col("peak.value") * sign).alias("peak_value"))


def _kept(flags: DataFrame, channel: str, min_duration: int, refractory: int) -> DataFrame:
    """channel, onset, offset of the events that crossings (s, flag: 1 up, 0 down) open and close, folded in order: only a kept event starts a refractory time."""
    rows = flags.groupBy(channel).agg(F.array_sort(F.collect_list(F.struct("s", "flag"))).alias("all"))
    event = "struct<onset:bigint,offset:bigint>"

    def made(onset: Column, offset: Column) -> Column:
        return F.array(F.struct(onset.cast("bigint").alias("onset"), offset.cast("bigint").alias("offset")))

    def step(state: Column, e: Column) -> Column:
        up, s, onset = e["flag"] == 1, e["s"].cast("bigint"), state["onset"]
        closes = ~up & onset.isNotNull()
        good = closes & (s - onset >= min_duration)
        return F.struct(
            F.when(closes, F.lit(None).cast("bigint")).when(up & onset.isNull() & (s >= state["ready"]), s).otherwise(onset).alias("onset"),
            F.when(good, s + refractory).otherwise(state["ready"]).alias("ready"),
            F.when(good, F.concat(state["kept"], made(onset, s))).otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(None).cast("bigint").alias("onset"), F.lit(-(2**62)).cast("bigint").alias("ready"), F.array().cast(f"array<{event}>").alias("kept"))
    finish = lambda s: F.when(s["onset"].isNotNull(), F.concat(s["kept"], made(s["onset"], F.lit(None)))).otherwise(s["kept"])
    return rows.select(channel, F.explode(F.aggregate("all", start, step, finish)).alias("e")).select(channel, "e.*")


def peak_candidates(signal: DataFrame, height: float, sign: int = 1, channel: str = "ch") -> DataFrame:
    """Samples above their predecessor and not below their successor, of such a height; a plateau counts at its first sample."""
    w = Window.partitionBy(channel).orderBy("s")
    v = F.col("v") * sign
    near = signal.withColumn("_p", F.lag("v").over(w) * sign).withColumn("_n", F.lead("v").over(w) * sign)
    return near.where((F.col("_p") < v) & (v >= F.col("_n")) & (v >= height)).select(channel, "s", "v")


def local_maxima(signal: DataFrame, channel: str = "ch") -> DataFrame:
    """Maxima with plateaus at their middle sample, rounded down; ends are never maxima."""
    w = Window.partitionBy(channel).orderBy("s")
    runs = signal.withColumn("_at", F.row_number().over(w)).withColumn("_new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    flat = runs.groupBy(channel, "_run").agg(F.min("_at").alias("a"), F.max("_at").alias("b"), F.first("v").alias("v"))
    ordered = Window.partitionBy(channel).orderBy("_run")
    top = flat.withColumn("p", F.lag("v").over(ordered)).withColumn("n", F.lead("v").over(ordered)).where((F.col("p") < F.col("v")) & (F.col("n") < F.col("v")))
    middle = top.select(channel, F.floor((F.col("a") + F.col("b")) / 2).alias("_at"))
    return middle.join(runs, [channel, "_at"]).select(channel, "s", "v")


def locally_exclusive(peaks: DataFrame, distance: int, channel: str = "ch", strength: Column | None = None) -> DataFrame:
    """Peaks that no other within less than the distance beats: stronger, or as strong and earlier."""
    power = F.abs(F.col("v")) if strength is None else strength
    rated = peaks.withColumn("_p", power)
    near = Window.partitionBy(channel).orderBy("s").rangeBetween(-(distance - 1), distance - 1)
    best = F.max(F.struct(F.col("_p").alias("p"), (-F.col("s")).alias("at"))).over(near)
    return rated.withColumn("_best", best).where((F.col("_best.p") == F.col("_p")) & (F.col("_best.at") == -F.col("s"))).drop("_p", "_best")


def threshold_spikes(signal: DataFrame, sigma: DataFrame, factor: float, refractory: int, sign: int = -1, channel: str = "ch") -> DataFrame:
    """Peaks of at least factor times the channel's noise, spaced by more than the refractory samples. sigma: channel, sigma; one row per channel."""
    w = Window.partitionBy(channel).orderBy("s")
    v = F.col("v") * sign
    near = signal.withColumn("_p", F.lag("v").over(w) * sign).withColumn("_n", F.lead("v").over(w) * sign).where((F.col("_p") < v) & (v >= F.col("_n")))
    high = near.join(sigma.where(F.col("sigma") > 0), channel).where(v >= F.col("sigma") * factor).select(channel, "s", "v")
    return locally_exclusive(high, refractory + 1, channel, v)


def spatial_dedup(events: DataFrame, sites: DataFrame, radius: float, window: int) -> DataFrame:
    """Spikes that no stronger one beats within a radius and so many samples, with all channels that took part.

    events: ch, s, v. sites: ch, x, y, z. Stronger: larger magnitude, then earlier,
    then the lower channel. Events of channels without a site go. Pairs are found in
    cells of time, so the join grows with the events near each other only.
    """
    a, b = sites.alias("a"), sites.alias("b")
    apart = sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz")
    # sites of one probe: hundreds, squared
    near = a.join(b, apart <= radius * radius).select(F.col("a.ch").alias("ch"), F.col("b.ch").alias("other"))
    cell = F.floor(F.col("s") / (window + 1))
    mine = events.join(near, "ch").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    theirs = events.select(F.col("ch").alias("other"), F.col("s").alias("t"), F.col("v").alias("u"), cell.alias("cell"))
    pairs = mine.join(theirs, ["other", "cell"]).where(F.abs(F.col("s") - F.col("t")) <= window)
    beaten = F.struct(F.abs("u"), -F.col("t"), -F.col("other")) > F.struct(F.abs("v"), -F.col("s"), -F.col("ch"))
    grouped = pairs.groupBy("ch", "s", "v").agg(F.max(beaten.cast("int")).alias("beaten"), F.sort_array(F.collect_set("other")).alias("channels"))
    return grouped.where(F.col("beaten") == 0).select("ch", "s", "v", "channels")


def bursts(rates: DataFrame, level: float, min_bins: int, unit: str = "unit") -> DataFrame:
    """Runs of at least so many bins with a rate of at least the level. rates: unit, bin, rate without gaps."""
    w = Window.partitionBy(unit).orderBy("bin")
    high = rates.where(F.col("rate") >= level).withColumn("run", F.col("bin") - F.row_number().over(w))
    return high.groupBy(unit, "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.max("rate").alias("top")).where(F.col("last_bin") - F.col("first_bin") + 1 >= min_bins).drop("run")


def snippets(signal: DataFrame, spikes: DataFrame, before: int, after: int, block: int | None = None) -> DataFrame:
    """unit, ch, s, w: the samples [s - before, s + after) around each spike of a channel; spikes whose window leaves the signal go."""
    size = block or max(before + after, 1)
    span = spikes.withColumn("cell", F.explode(F.sequence(F.floor((F.col("s") - before) / size), F.floor((F.col("s") + after - 1) / size))))
    cells = signal.select("ch", F.col("s").alias("t"), F.col("v").alias("_v"), F.floor(F.col("s") / size).alias("cell"))
    hit = span.join(cells, ["ch", "cell"]).where((F.col("t") >= F.col("s") - before) & (F.col("t") < F.col("s") + after))
    out = hit.groupBy("unit", "ch", "s").agg(F.array_sort(F.collect_list(F.struct("t", "_v"))).alias("all"))
    return out.where(F.size("all") == before + after).select("unit", "ch", "s", F.transform("all", lambda x: x["_v"]).alias("w"))


def event_order(events: DataFrame, keys: Sequence[str] = ("onset", "ch", "peak_value")) -> DataFrame:
    return events.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
