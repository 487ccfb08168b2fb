"""Filters against plain numpy, and block lengths that mustn't matter."""

import math

import numpy as np
import pytest

from sigtrellis.functions import design
from sigtrellis.operators import blocks, channels, events, waveforms
from sigtrellis.plans import pipeline


def long(spark, x):
    return spark.createDataFrame([(c, s, float(v)) for c, row in enumerate(x) for s, v in enumerate(row)], "ch int, s long, v double")


def matrix(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.ch, r.s] = r.v
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(size=(2, 700)) * 10


def test_butterworth_gain():
    s = design.iir("butterworth", 4, "lowpass", [100.0], 1000.0)

    def gain(f):
        z = np.exp(2j * math.pi * f / 1000.0)
        return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in s]))

    assert gain(1e-6) == pytest.approx(1, abs=1e-9)
    assert gain(100) == pytest.approx(0.5**0.5, abs=1e-9)
    assert gain(300) < 0.01


@pytest.mark.parametrize("band,freqs,inside,outside", [("highpass", [100.0], 400, 5), ("bandpass", [50.0, 200.0], 105, 2), ("bandstop", [50.0, 200.0], 2, 100)])
@pytest.mark.parametrize("kind,ripple", [("butterworth", None), ("chebyshev1", 0.5), ("bessel", None)])
def test_designs_pass_and_stop(kind, ripple, band, freqs, inside, outside):
    s = design.iir(kind, 3, band, freqs, 1000.0, ripple)
    x = lambda f: np.sin(2 * np.pi * f * np.arange(4000) / 1000)
    level = lambda f: np.abs(design.sosfilt(s, x(f))[0][2000:]).max()
    assert level(inside) > 0.7 and level(outside) < 0.2


def test_notch_removes_its_frequency():
    s = design.notch(60.0, 30.0, 1000.0)
    x = np.sin(2 * np.pi * 60 * np.arange(8000) / 1000)
    assert np.abs(design.sosfilt(s, x)[0][6000:]).max() < 1e-2


def test_sections_are_checked():
    with pytest.raises(ValueError):
        design.checked([[1, 0, 0, 1, 0, 1.5]])


@pytest.mark.parametrize("block", [64, 233])
def test_causal_filter_by_halo_and_exactly(spark, noise, block):
    s = design.iir("butterworth", 3, "lowpass", [80.0], 1000.0)
    want = design.sosfilt(s, noise)[0]
    exact = matrix(blocks.iir_exact(long(spark, noise), s, block), noise.shape)
    halo = matrix(blocks.run(long(spark, noise), [blocks.iir(s)], block), noise.shape)
    assert np.abs(exact - want).max() < 1e-9
    assert np.abs(halo - want).max() < 1e-4


def test_zero_phase_does_not_depend_on_blocks(spark, noise):
    k = [blocks.iir(design.iir("butterworth", 2, "bandpass", [50.0, 200.0], 1000.0), zero_phase=True), blocks.gaussian(1.5), blocks.running_median(5)]
    a, b = (matrix(blocks.run(long(spark, noise), k, n), noise.shape) for n in (100, 5000))
    assert np.abs(a - b).max() < 1e-3 * np.abs(b).max()


def test_long_fir_equals_convolution(spark, noise):
    taps = design.firwin(101, 0.3)
    got = matrix(blocks.run(long(spark, noise), [blocks.fir(taps, centred=True)], 128), noise.shape)
    want = np.stack([np.convolve(r, taps)[50 : 50 + 700] for r in noise])
    assert np.abs(got - want).max() < 1e-9


def test_resample_equals_direct_sum(spark, noise):
    up, down = 2, 3
    taps, half = design.resample_taps(up, down)
    n = -(-700 * up // down)
    want = np.zeros((2, n))
    for m in range(n):
        for s in range(700):
            k = m * down - s * up + half
            if 0 <= k < len(taps):
                want[:, m] += taps[k] * noise[:, s]
    got = matrix(blocks.resample(long(spark, noise), up, down, 64), want.shape)
    assert np.abs(got - want).max() < 1e-9


def test_template_subtraction():
    t = np.array([0.0, 1.0, -2.0, 1.0])
    x = np.zeros(50)
    x[22:26] = 3 * t
    assert np.abs(blocks.subtract_template(t, [20], 4)(x)).max() < 1e-12


def brute_crossings(x, level, release, min_duration, refractory):
    out, onset, ready, prev = [], None, -(10**9), float("nan")
    for s, v in enumerate(x):
        if prev < level <= v:
            if onset is None:
                if s >= ready:
                    onset, at, top = s, s, v
            elif v > top:
                at, top = s, v
        elif prev >= release > v:
            if onset is not None:
                if s - onset >= min_duration:
                    out.append((onset, s, at, top))
                    ready = s + refractory
                onset = None
        elif onset is not None and v > top:
            at, top = s, v
        prev = v
    return out + ([(onset, None, at, top)] if onset is not None else [])


def test_crossings_match_a_state_machine(spark, noise):
    for low in (4.0, -3.0):
        got = [(r.onset, r.offset, r.peak_sample, r.peak_value) for r in events.crossings(long(spark, noise[:1]), 5.0, low).orderBy("onset").collect()]
        assert got == brute_crossings(noise[0], 5.0, low, 0, 0)


@pytest.mark.parametrize("shortest, wait", [(0, 2), (2, 0), (3, 7)])
def test_refractory_crossings_match_a_state_machine(spark, noise, shortest, wait):
    for x in (np.array([0, 6, 0, 6, 3, 6, 0, 0, 9.0]), noise[0]):
        got = [(r.onset, r.offset, r.peak_sample, r.peak_value) for r in events.crossings(long(spark, x[None, :]), 5.0, 1.0, min_duration=shortest, refractory=wait).orderBy("onset").collect()]
        assert got == brute_crossings(x, 5.0, 1.0, shortest, wait)
    down = [(r.onset, r.offset, r.peak_sample, -r.peak_value) for r in events.crossings(long(spark, -noise[:1]), -5.0, -1.0, min_duration=shortest, refractory=wait, direction="falling").orderBy("onset").collect()]
    assert down == brute_crossings(noise[0], 5.0, 1.0, shortest, wait)


def test_gaps_keep_their_length(spark):
    rows = spark.createDataFrame([(0, s, 1.0) for s in (0, 1, 2, 10, 11)], "ch int, s long, v double")
    for block in (3, 100):
        got = {r.s: r.v for r in blocks.run(rows, [blocks.fir([0.5, 0.5])], block).collect()}
        assert got == {0: 0.5, 1: 1.0, 2: 1.0, 10: 0.5, 11: 1.0}


def test_probe_places():
    assert waveforms.presets("neuropixels2")[96] == (96, 250.0, 0.0) and len(waveforms.presets("utah")) == 96


def test_channel_operators_refuse_bad_arguments():
    with pytest.raises(ValueError):
        channels.reorder(None, [1, 1])
    with pytest.raises(ValueError):
        channels.clamp(None, 2.0, 1.0)


def test_specs_report_every_error():
    with pytest.raises(ValueError) as e:
        pipeline.load({"version": 2, "nodes": {"a": {"op": "read"}, "b": {"op": "nothing"}, "c": {"op": "iir", "band": "lowpass", "freqs": [1], "design": "chebyshev1", "more": 1}}, "edges": [["a", "x"]]})
    for part in ("version", "path is missing", "no operation", "unknown field more", "ripple", "no such node", "c isn't connected"):
        assert part in str(e.value)
    with pytest.raises(ValueError, match="future"):
        pipeline.load(pipeline.recipe("spike band", "x", 30000.0) | {"execution": {"mode": "stream", "rate": 30000.0}})


def test_pipeline_branches_share_their_prefix(spark, noise):
    spec = {"version": 1, "nodes": {"in": {"op": "table", "name": "x"}, "s": {"op": "scale", "alpha": 2.0}, "r": {"op": "rectify"}, "c": {"op": "car"}}, "edges": [["in", "s"], ["s", "r"], ["s", "c"]]}
    out = pipeline.run(spark, spec, {"x": long(spark, noise)})
    assert np.allclose(matrix(out["r"], noise.shape), np.abs(noise * 2))
    assert np.allclose(matrix(out["c"], noise.shape), 2 * (noise - noise.mean(0)))
    assert [p["node"] for p in pipeline.plan(pipeline.load(spec))][0] == "in"
