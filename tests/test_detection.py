"""Detectors, waveforms and clusters with known answers."""

import numpy as np
import pytest

from sigtrellis.operators import clusters, detection, events, waveforms


def test_peak_rules():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 1.5, 2, 0, 5, 0.0])
    got = detection.peaks_of(x)
    assert got["at"].tolist() == [1, 4, 7, 9, 11]
    assert got["prominence"].tolist() == [1, 3, 2, 2, 5]
    assert detection.peaks_of(x, height=2.5)["at"].tolist() == [4, 11]
    assert detection.peaks_of(x, distance=4)["at"].tolist() == [4, 11]
    assert detection.peaks_of(x, prominence=2.5)["at"].tolist() == [4, 11]
    assert detection.peaks_of(np.array([0, 2.0, 0]))["width"].tolist() == [1.0]


def test_detectors_find_planted_spikes(spark):
    rng = np.random.default_rng(3)
    wave = detection.prototype(20, 20000.0)
    x = rng.normal(size=3000) * 0.05
    at = [200, 900, 1500, 2400]
    for a in at:
        x[a : a + 20] += wave * 3
    signal = spark.createDataFrame([(0, s, float(v)) for s, v in enumerate(x)], "ch long, s long, v double")
    trough = int(wave.argmin())
    for got in (
        detection.matched_spikes(signal, wave, 8.0, 30).select((events.F.col("s") + trough).alias("s")),
        detection.adaptive_spikes(signal, 500, 0.3, 8.0, 30),
        detection.energy_spikes(signal, 20.0, 30),
    ):
        found = sorted(r.s for r in got.collect())
        assert len(found) == 4 and all(abs(f - a - trough) <= 2 for f, a in zip(found, at))
    peeled = waveforms.matching_pursuit(signal, {7: wave.tolist()}, 0, 1.0, 256).orderBy("s").collect()
    assert [(r.unit, r.s) for r in peeled] == [(7, a) for a in at]


def test_density_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(6, 0.3, (50, 2)), rng.uniform(-20, 20, (6, 2))])
    labels = clusters.hdbscan_labels(x, 8)
    assert len(set(labels[:60])) <= 2 and len(set(labels[60:110])) <= 2
    assert np.bincount(labels[:60] + 1).argmax() != np.bincount(labels[60:110] + 1).argmax() and (labels[110:] == -1).sum() >= 4


def test_ica_unmixes(spark):
    t = np.arange(2000)
    sources = np.stack([np.sign(np.sin(t / 15)), ((t % 70) / 35 - 1)], axis=1)
    mixed = sources @ np.array([[1.0, 0.5], [0.3, 1.0]])
    w = clusters.fast_ica(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mixed)], "id long, x array<double>"), 2)
    c = np.abs(np.corrcoef((mixed @ w.T).T, sources.T)[:2, 2:])
    assert c.max(1).min() > 0.95


def test_valleys_and_ppca():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.2, 100), np.random.default_rng(1).normal(3, 0.2, 100)])
    assert clusters.kde_valleys(x, 0.2).tolist() == [0] * 100 + [1] * 100
    loadings, noise = clusters.ppca(np.diag([5.0, 1.0, 1.0]), 1)
    assert noise == pytest.approx(1.0) and abs(loadings[0, 0]) == pytest.approx(2.0)


def test_monopole_is_found(spark):
    sites = {i: (20.0 * (i % 4), 20.0 * (i // 4)) for i in range(16)}
    amp = [(1, c, 900.0 / float(np.sqrt((x - 25) ** 2 + (y - 33) ** 2 + 15**2))) for c, (x, y) in sites.items()]
    r = waveforms.monopoles(spark.createDataFrame(amp, "unit long, ch int, amp double"), sites).first()
    assert (r.x, r.y, r.z) == pytest.approx((25, 33, 15), abs=0.5)
