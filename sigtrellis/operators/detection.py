"""Spike detectors over long signals. Noise levels are tables of a row per channel; candidates are found by window functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrellis.functions import stats, trains
from sigtrellis.operators import blocks, events, temporal


def spacing(rate: float, milliseconds: float) -> int:
    """Refractory samples of a time, one at least."""
    return max(1, round(rate * milliseconds / 1000))


def noise_levels(signal: DataFrame, chunk: int, chunks: int, samples: int) -> DataFrame:
    """ch, sigma: the median over evenly spread chunks of each chunk's noise."""
    starts = [round(i * max(0, samples - chunk) / max(1, chunks - 1)) for i in range(chunks)]
    which = F.lit(None).cast("int")
    for i, a in enumerate(starts):
        which = F.when((F.col("s") >= a) & (F.col("s") < a + chunk), i).otherwise(which)
    each = signal.withColumn("_k", which).where(F.col("_k").isNotNull()).groupBy("ch", "_k").agg(stats.noise(F.col("v")).alias("sigma"))
    return each.groupBy("ch").agg(F.percentile("sigma", 0.5).alias("sigma"))


def energy_spikes(signal: DataFrame, factor: float, refractory: int) -> DataFrame:
    """Maxima of the non-linear energy of at least factor deviations where the signal is negative, moved to its least value within two samples."""
    w = temporal.over()
    near = Window.partitionBy("ch").orderBy("s").rowsBetween(-2, 2)
    rated = signal.select("ch", "s", "v", temporal.nonlinear_energy(F.col("v"), w).alias("e"), F.min(F.struct("v", "s")).over(near).alias("low"))
    sigma = rated.groupBy("ch").agg(stats.noise(F.col("e")).alias("sigma"))
    peaks = rated.withColumn("p", F.lag("e").over(w)).withColumn("n", F.lead("e").over(w)).where((F.col("p") < F.col("e")) & (F.col("e") >= F.col("n")) & (F.col("v") < 0))
    high = peaks.join(sigma, "ch").where((F.col("sigma") > 0) & (F.col("e") >= F.col("sigma") * factor))
    kept = events.locally_exclusive(high.select("ch", "s", "v", "e", "low"), refractory + 1, "ch", F.col("e"))
    return kept.select("ch", F.col("low.s").alias("s"), F.col("low.v").alias("v"))


def adaptive_levels(signal: DataFrame, block: int, alpha: float) -> DataFrame:
    """ch, blk, level: noise of each block smoothed along the channel; blocks without noise keep the level before."""
    size = max(32, block)
    each = signal.groupBy("ch", F.floor(F.col("s") / size).alias("blk")).agg(stats.noise(F.col("v")).alias("sigma"))
    rows = each.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("blk", "sigma"))).alias("all"))

    def step(state: Column, b: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))["level"]
        level = F.when(last.isNull(), F.greatest(b["sigma"], F.lit(1e-6))).when(b["sigma"] > 0, last * (1 - alpha) + b["sigma"] * alpha).otherwise(last)
        return F.concat(state, F.array(F.struct(b["blk"].alias("blk"), level.alias("level"))))

    return rows.select("ch", F.explode(F.aggregate("all", F.array().cast("array<struct<blk:bigint,level:double>>"), step)).alias("e")).select("ch", "e.blk", "e.level")


def adaptive_spikes(signal: DataFrame, block: int, alpha: float, factor: float, refractory: int, sign: int = -1) -> DataFrame:
    """Extrema that reach factor times the smoothed noise of their block."""
    size = max(32, block)
    peaks = events.peak_candidates(signal, -math.inf, sign).withColumn("blk", F.floor(F.col("s") / size))
    high = peaks.join(adaptive_levels(signal, block, alpha), ["ch", "blk"]).where(F.col("v") * sign >= F.col("level") * factor)
    return events.locally_exclusive(high.select("ch", "s", "v"), refractory + 1, "ch", F.col("v") * sign)


def prototype(samples: int, rate: float, width_ms: float = 0.4) -> np.ndarray:
    """A biphasic wave with mean 0 and norm 1, trough first."""
    t = (np.arange(samples) - samples // 3) / rate * 1000
    w = -np.exp(-0.5 * (t / (width_ms / 2)) ** 2) + 0.4 * np.exp(-0.5 * ((t - 1.5 * width_ms) / width_ms) ** 2)
    w -= w.mean()
    return w / np.linalg.norm(w)


def matched_spikes(signal: DataFrame, wave: Sequence[float], factor: float, refractory: int, block: int = blocks.BLOCK) -> DataFrame:
    """Peaks of the inner product with a wave, at the place of its first sample, of at least factor times the product's noise."""
    w = np.asarray(wave, float)
    kernel = blocks.Kernel(lambda x, first, last: np.correlate(np.concatenate([x, np.zeros(len(w) - 1)]), w, "valid"), 0, len(w) - 1)
    product = blocks.run(signal, [kernel], block).persist()
    return events.threshold_spikes(product, product.groupBy("ch").agg(stats.noise(F.col("v")).alias("sigma")), factor, refractory, sign=1)


def _prominence(x: np.ndarray, peaks: np.ndarray, wlen: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.zeros((3, len(peaks)))
    for k, p in enumerate(peaks):
        lo, hi = (0, len(x) - 1) if wlen is None else (max(0, p - wlen // 2), min(len(x) - 1, p + wlen // 2))
        higher = np.flatnonzero(x[lo:p] > x[p])
        a = lo + higher[-1] + 1 if len(higher) else lo
        higher = np.flatnonzero(x[p + 1 : hi + 1] > x[p])
        b = p + higher[0] if len(higher) else hi
        left, right = a + len(x[a : p + 1]) - 1 - int(np.argmin(x[a : p + 1][::-1])), p + int(np.argmin(x[p : b + 1]))
        out[:, k] = x[p] - max(x[left], x[right]), left, right
    return out[0], out[1].astype(int), out[2].astype(int)


def _width(x: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = x[p] - prominence[k] * share
        i = p
        while i > left[k] and x[i] > level:
            i -= 1
        a = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        i = p
        while i < right[k] and x[i] > level:
            i += 1
        b = i - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else float(i)
        out[k] = b - a
    return out


def peaks_of(x: np.ndarray, height: float | None = None, threshold: float | None = None, distance: int | None = None, prominence: float | None = None, width: float | None = None, wlen: int | None = None, share: float = 0.5) -> pd.DataFrame:
    """Peaks of one array, narrowed by height, threshold, distance (highest first), prominence and width, in this order."""
    change = np.flatnonzero(np.diff(x) != 0)
    start, stop = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    inner = np.arange(1, len(start) - 1)
    top = inner[(x[start[inner - 1]] < x[start[inner]]) & (x[start[inner + 1]] < x[start[inner]])] if len(inner) else inner
    p = (start[top] + stop[top]) // 2 if len(top) else np.zeros(0, int)
    if height is not None:
        p = p[x[p] >= height]
    if threshold is not None:
        p = p[np.minimum(x[p] - x[p - 1], x[p] - x[p + 1]) >= threshold]
    if distance is not None and len(p):
        keep = np.ones(len(p), bool)
        for i in np.argsort(x[p], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(p - p[i]) < distance
                near[i] = False
                keep[near] = False
        p = p[keep]
    prom, left, right = _prominence(x, p, wlen)
    if prominence is not None:
        good = prom >= prominence
        p, prom, left, right = p[good], prom[good], left[good], right[good]
    wide = _width(x, p, prom, left, right, share)
    good = np.ones(len(p), bool) if width is None else wide >= width
    return pd.DataFrame({"at": p[good], "v": x[p[good]], "prominence": prom[good], "width": wide[good]})


def find_peaks(signal: DataFrame, **rules) -> DataFrame:
    """ch, s, v, prominence, width. A channel is one task, since a prominence may reach to its ends."""

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", kind="stable")
        got = peaks_of(rows["v"].to_numpy(float), **rules)
        return pd.DataFrame({"ch": key[0], "s": rows["s"].to_numpy()[got["at"].to_numpy()], "v": got["v"], "prominence": got["prominence"], "width": got["width"]})

    return signal.groupBy("ch").applyInPandas(find, "ch long, s long, v double, prominence double, width double")


def detect(signal: DataFrame, sites: DataFrame, samples: int, rate: float, factor: float = 5.0, radius: float = 150.0, before: int = 30, after: int = 60, chain: Sequence[blocks.Kernel] = (), chunk_s: float = 1.0, chunks: int = 5) -> dict[str, DataFrame]:
    """Filter, noise, threshold, spatial dedup, snippets and mean waveforms; each a DataFrame."""
    x = blocks.run(signal, chain) if chain else signal
    sigma = noise_levels(x, int(chunk_s * rate), chunks, samples)
    spikes = events.spatial_dedup(events.threshold_spikes(x, sigma, factor, spacing(rate, 1.0)), sites, radius, spacing(rate, 0.5))
    waves = events.snippets(x, spikes.select(F.col("ch").alias("unit"), "ch", "s"), before, after)
    return {"noise": sigma, "spikes": spikes, "snippets": waves, "templates": stats.element_moments(waves, "unit")}


def locally_exclusive_sites(peaks: DataFrame, neighbours: DataFrame, window: int) -> DataFrame:
    """Peaks that no larger one beats on a neighbouring channel within a window; ties to the earlier, then the lower channel. neighbours: ch, other."""
    near = trains.near_pairs(peaks.join(neighbours, "ch"), peaks.select(F.col("ch").alias("other"), F.col("s").alias("t"), F.col("v").alias("u")), window, ("other",))
    beaten = F.struct(F.abs("u"), -F.col("t"), -F.col("other")) > F.struct(F.abs("v"), -F.col("s"), -F.col("ch"))
    worse = near.where(beaten).select("ch", "s").distinct()
    return peaks.join(worse, ["ch", "s"], "left_anti")
