"""Features and places of waveforms, template similarity and matching. Templates are rows unit, ch, w (array)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrellis.operators import blocks
from sigtrellis.operators.points import dot


def peak_to_peak(w: Column) -> Column:
    return F.array_max(w) - F.array_min(w)


def top_channels(templates: DataFrame, k: int) -> DataFrame:
    """The k channels of each unit with the largest peak to peak, ties to the lower channel."""
    order = Window.partitionBy("unit").orderBy(peak_to_peak(F.col("w")).desc(), "ch")
    return templates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def morphology(w: Column) -> Column:
    """struct(trough, peak, trough_to_peak, half_width, recovery): indices, and samples between them."""
    low = F.array_min(w)
    trough = F.array_position(w, low).cast("int") - 1
    after = F.slice(w, trough + 1, F.size(w))
    peak = trough + F.array_position(after, F.array_max(after)).cast("int") - 1
    half = low / 2
    run = lambda a: F.coalesce(F.array_position(F.transform(a, lambda v: v > half), True).cast("int") - 1, F.size(a))
    left = run(F.reverse(F.slice(w, F.lit(1), trough + 1)))
    slope = (F.get(w, peak) - low) / F.greatest(peak - trough, F.lit(1))
    return F.struct(trough.alias("trough"), peak.alias("peak"), (peak - trough).alias("trough_to_peak"), (left + run(after) - 1).alias("half_width"), slope.alias("recovery"))


def similarity(templates: DataFrame, max_lag: int = 0) -> DataFrame:
    """a, b, cosine: the largest cosine over lags of two units' waveforms on the channels they share."""
    t = templates.select("unit", "ch", "w")
    pairs = t.select(F.col("unit").alias("a"), "ch", F.col("w").alias("x")).join(t.select(F.col("unit").alias("b"), "ch", F.col("w").alias("y")), "ch").where(F.col("a") < F.col("b"))
    n = F.size("x")
    lagged = pairs.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    x = F.slice("x", F.greatest(F.col("lag"), F.lit(0)) + 1, n - F.abs("lag"))
    y = F.slice("y", F.greatest(-F.col("lag"), F.lit(0)) + 1, n - F.abs("lag"))
    sums = lagged.select("a", "b", "lag", dot(x, y).alias("xy"), dot(x, x).alias("xx"), dot(y, y).alias("yy")).groupBy("a", "b", "lag").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return sums.groupBy("a", "b").agg(F.max(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0)).alias("cosine"))


def merge_groups(pairs: DataFrame, least: float) -> dict[int, int]:
    """The least unit of each group of units that similar pairs connect; pairs of units, a small table."""
    parent: dict[int, int] = {}

    def find(u: int) -> int:
        while parent.setdefault(u, u) != u:
            u = parent[u]
        return u

    for r in pairs.where(F.col("cosine") >= least).orderBy("a", "b").collect():
        a, b = sorted((find(r.a), find(r.b)))
        parent[b] = a
    return {u: find(u) for u in parent}


def clean(templates: DataFrame, noise: DataFrame, least_snr: float = 3.0) -> DataFrame:
    """Units whose largest channel stands out of the noise (ch, sigma); empty ones go."""
    rated = templates.join(noise, "ch").groupBy("unit").agg(F.max(peak_to_peak(F.col("w")) / F.when(F.col("sigma") > 1e-6, F.col("sigma"))).alias("snr"))
    return templates.join(rated.where(F.col("snr") >= least_snr).select("unit"), "unit", "left_semi")


def snr(amplitude: Column, sigma: Column) -> Column:
    """NaN where there is no noise."""
    return F.when(sigma > 1e-6, F.abs(amplitude) / sigma).otherwise(float("nan"))


def matching_pursuit(signal: DataFrame, templates: dict[int, Sequence[float]], channel: int, least: float, block: int = blocks.BLOCK) -> DataFrame:
    """unit, s, amplitude of spikes found by taking off the best template again and again, in halo windows; a spike belongs to the window of its start."""
    waves = {u: np.asarray(w, float) for u, w in templates.items()}
    longest = max(map(len, waves.values()))
    x = signal.where(F.col("ch") == channel)
    read = x.select("s", "v", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / block), F.floor((F.col("s") - longest) / block), F.floor((F.col("s") + longest) / block)))).alias("win"))

    def peel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", kind="stable")
        s0, r, out = int(rows["s"].iloc[0]), rows["v"].to_numpy(float).copy(), []
        while True:
            best = None
            for u, w in waves.items():
                if len(r) >= len(w):
                    p = np.correlate(r, w, "valid")
                    i = int(p.argmax())
                    gain = p[i] ** 2 / (w @ w) if p[i] > 0 else 0.0
                    if best is None or gain > best[0]:
                        best = (gain, u, i, p[i] / (w @ w))
            if best is None or best[3] < least:
                break
            _, u, i, a = best
            r[i : i + len(waves[u])] -= a * waves[u]
            if key[0] * block <= s0 + i < (key[0] + 1) * block:
                out.append((u, s0 + i, float(a)))
        return pd.DataFrame(out, columns=["unit", "s", "amplitude"])

    return read.where(F.col("win") >= 0).groupBy("win").applyInPandas(peel, "unit long, s long, amplitude double")


def monopoles(amplitudes: DataFrame, sites: dict[int, Sequence[float]], rounds: int = 60) -> DataFrame:
    """unit, x, y, z, strength of a point source that explains amplitudes (unit, ch, amp): damped least squares from the centre of mass."""
    place = {c: np.asarray(p, float) for c, p in sites.items()}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, a = np.stack([place[c] for c in rows["ch"]]), rows["amp"].abs().to_numpy(float)
        q = np.concatenate([(p * a[:, None]).sum(0)[:2] / max(a.sum(), 1e-12), [20.0]])
        q = np.append(q, a.max() * 20.0)
        damp = 1e-2

        def model(q):
            return q[3] / np.sqrt(((p[:, :2] - q[:2]) ** 2).sum(1) + q[2] ** 2 + 1e-9)

        for _ in range(rounds):
            e = a - model(q)
            j = np.stack([(model(q + d) - model(q)) / d.sum() for d in np.eye(4) * (1e-4 * (1 + np.abs(q)))], axis=1)
            h = j.T @ j
            step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ e, rcond=None)[0]
            if ((a - model(q + step)) ** 2).sum() < (e**2).sum():
                q, damp = q + step, damp / 3
            else:
                damp *= 4
        return pd.DataFrame([(key[0], q[0], q[1], abs(q[2]), q[3])], columns=["unit", "x", "y", "z", "strength"])

    return amplitudes.groupBy("unit").applyInPandas(fit, "unit long, x double, y double, z double, strength double")


def presets(name: str, count: int = 384) -> list[tuple[int, float, float]]:
    """Site, x, y of common probes: neuropixels1, neuropixels2 (four shanks of 96), tetrode (a cross), emg_grid (8 columns), utah (without corners)."""
    if name == "neuropixels1":
        return [(i, (43.0, 11.0, 59.0, 27.0)[i % 4], 20.0 * (i // 2)) for i in range(count)]
    if name == "neuropixels2":
        return [(i, 250.0 * (i // 96) + 32.0 * (i % 2), 15.0 * (i % 96 // 2)) for i in range(count)]
    if name == "tetrode":
        return [(0, -12.5, 0.0), (1, 12.5, 0.0), (2, 0.0, -12.5), (3, 0.0, 12.5)]
    if name == "emg_grid":
        return [(i, 8000.0 * (i % 8), 8000.0 * (i // 8)) for i in range(count)]
    if name == "utah":
        cells = [(row, col) for row in range(10) for col in range(10) if not (row in (0, 9) and col in (0, 9))]
        return [(i, 400.0 * col, 400.0 * row) for i, (row, col) in enumerate(cells)][:count]
    raise ValueError(f"no probe called {name}")
