"""Quality of units against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from sigtrellis.functions import quality


def brute_cutoff(amps, bins, sigma, least):
    x = np.abs(amps)
    if len(x) / bins < least:
        return math.nan
    counts = np.histogram(x, bins)[0].astype(float)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * np.arange(-r, r + 1) ** 2 / sigma**2)
    p = np.convolve(np.pad(counts, r, mode="edge"), w / w.sum(), "valid").astype(int)
    missed = p[np.flatnonzero(p >= p[0])[-1] + 1 :].sum()
    return min(missed / (len(x) + missed), 0.5)


def test_amplitude_cutoff(spark):
    r = np.random.default_rng(1)
    amps = {0: r.normal(50, 10, 3000), 1: np.clip(r.normal(50, 10, 4000), 45, None), 2: r.normal(50, 5, 30), 3: np.full(900, -7.0)}
    amps[1] = amps[1][amps[1] > 45]
    rows = [(u, float(a)) for u, x in amps.items() for a in x] + [(0, None)]
    got = {x.unit: x.cutoff for x in quality.amplitude_cutoff(spark.createDataFrame(rows, "unit long, amp double"), 50).collect()}
    assert math.isnan(got.pop(2)) and len(got) == 3
    for u, g in got.items():
        assert abs(g - brute_cutoff(amps[u], 50, 3.0, 5.0)) < 2e-3
    assert got[1] > got[0]


def brute_refractory(counts, half, shoulder, most, ignored):
    h = np.array([counts.get(k, 0) for k in range(-half, half + 1)], float)
    base = max(h[: half - shoulder + 1].mean(), h[half + shoulder :].mean())
    if base <= 0:
        return math.inf, 1.0, base
    ratios, ps = [], []
    for k in range(ignored, min(most, half - 1) + 1):
        lags = [x for x in range(-k, k + 1) if abs(x) >= ignored]
        n, lam = sum(h[half + x] for x in lags), len(lags) * base
        ratios.append(n / lam)
        ps.append(0.5 * (1 + math.erf((n - lam) / math.sqrt(1e-10 + 2 * lam))))
    return min(ratios), min(1.0, *ps), base


def test_refractory_statistics(spark):
    r = np.random.default_rng(2)
    units = {0: {k: int(r.poisson(20)) for k in range(-30, 31) if abs(k) > 3}, 1: {k: int(r.poisson(20)) for k in range(-30, 31)}, 2: {1: 4}}
    table = spark.createDataFrame([(u, k, n) for u, h in units.items() for k, n in h.items()], "unit long, lag int, n long")
    for ignored in (0, 1, 2):
        got = {x.unit: x for x in quality.refractory_stats(table, 30, 20, ignored=ignored).collect()}
        for u, h in units.items():
            for a, b in zip((got[u].ratio, got[u].probability, got[u].baseline), brute_refractory(h, 30, 20, 10, ignored)):
                assert a == b or abs(a - b) < 2e-7
    judged = {x.unit: x.refractory for x in quality.is_refractory(quality.refractory_stats(table, 30, 20), 0.2, 0.2).collect()}
    assert judged == {0: True, 1: False, 2: False}


def test_units_without_pairs_are_not_refractory(spark):
    out = quality.train_refractory(spark.createDataFrame([(7, 10)], "unit long, s long"), 30, 20, 10).first()
    assert (out.unit, out.ratio, out.probability, out.baseline, out.refractory) == (7, math.inf, 1.0, 0.0, False)


def test_composite_score(spark):
    rows = [(0.1, 0.9, 0.05, 20.0, 30.0, 6.0), (1.4, 0.9, 0.05, 20.0, 30.0, 6.0), (0.1, 0.9, math.nan, 20.0, 30.0, 6.0), (0.1, 0.9, 0.05, 20.0, 30.0, math.inf), (0.1, 0.9, 0.05, 20.0, 30.0, None)]
    t = spark.createDataFrame(rows, "c double, p double, a double, r double, f double, s double")
    scored = t.select(quality.composite(*[F.col(x) for x in "cparfs"]).alias("q")).select("q.*")
    got = [x.score for x in scored.collect()]
    want = 0.9 * 0.9 * 0.95 / (1 + math.exp(-180)) / (1 + math.exp(-170)) * (1 - 1 / (1 + math.exp(2)))
    assert abs(got[0] - want) < 1e-12 and got[1:] == [0.0] * 4
    assert abs(quality.sort_score(scored).first().score - want / 5) < 1e-12
    assert quality.sort_score(scored.limit(0)).first().score is None


def test_evoked_responses(spark):
    wave = {o: 0.1 * (-1) ** o for o in range(-20, 60)}
    wave |= {o: 5.0 * math.sin((o - 10) / 3) for o in range(10, 30)}
    t = spark.createDataFrame([(0, o, v) for o, v in wave.items()] + [(1, o, 0.0) for o in range(-5, 2)], "ch int, offset int, mean double")
    got = {x.ch: x for x in quality.evoked(t, 1000.0, 2.0, 40.0, 5.0).collect()}
    inside = np.array([wave[o] for o in range(2, 41)]) - np.mean([wave[o] for o in range(-20, 0)])
    sd = np.std([wave[o] for o in range(-20, 0)])
    assert got[0].onset_ms == 2 + np.flatnonzero(np.abs(inside) > 5 * sd)[0]
    assert np.allclose([got[0].peak_to_peak, got[0].rms, got[0].area], [np.ptp(inside), np.sqrt(np.mean(inside**2)), np.abs(inside).sum()])
    assert (got[1].onset_ms, got[1].peak_to_peak, got[1].rms, got[1].area) == (None, None, None, None)
