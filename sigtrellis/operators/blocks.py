"""Window kernels over blocks of samples with halos.

A block is a row per recording, channel and window of the long signal. Windows are
contiguous; each is read with so many samples more on its left and right as the
chain needs (the sum over its stages) and cropped afterwards, so the result doesn't
depend on the block length. A sample goes to at most a few windows, and one shuffle
by window serves a whole chain of kernels.

Recursive filters use the halo that lets the impulse response decay to a tolerance;
``iir_exact`` carries exact states between blocks instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrellis.functions import design

BLOCK = 4096
_LONG = "ch int, s long, v double"


@dataclass(frozen=True)
class Kernel:
    """apply(x, first, last): x is one channel's padded window; first and last tell whether it touches a true end."""

    apply: Callable[[np.ndarray, bool, bool], np.ndarray]
    left: int = 0
    right: int = 0


def extend(x: np.ndarray, n: int, mode: str, left: bool = True, right: bool = True) -> np.ndarray:
    """Adds n samples at the ends that are asked for: zeros, odd, reflect (the end repeats) or nearest."""
    kinds = {"zeros": ("constant", {}), "odd": ("reflect", {"reflect_type": "odd"}), "reflect": ("symmetric", {}), "nearest": ("edge", {})}
    how, options = kinds[mode]
    if mode in ("odd",) and len(x) == 1:
        how, options = "edge", {}
    return np.pad(x, (n if left else 0, n if right else 0), mode=how, **options)


def fir(taps: Sequence[float], centred: bool = False, edge: str = "zeros") -> Kernel:
    """Convolution; long taps go through the Fourier transform."""
    h = np.asarray(taps, float)
    right = (len(h) - 1) // 2 if centred else 0
    left = len(h) - 1 - right

    def apply(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        y = extend(x, len(h), edge)
        if len(h) >= 64:
            n = 1 << (len(y) + len(h) - 1).bit_length()
            full = np.fft.irfft(np.fft.rfft(y, n) * np.fft.rfft(h, n), n)
        else:
            full = np.convolve(y, h)
        return full[len(h) + right : len(h) + right + len(x)]

    return Kernel(apply, left, right)


def gaussian(sigma: float, truncate: float = 4.0) -> Kernel:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return fir(k / k.sum(), centred=True, edge="reflect")


def running_median(width: int) -> Kernel:
    r = width // 2

    def apply(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, r), width), axis=1)

    return Kernel(apply, r, r)


def iir(sections: np.ndarray, tolerance: float = 2.0**-23, zero_phase: bool = False, steady: bool = False) -> Kernel:
    """Recursive filter through its truncated impulse response; zero phase runs it both ways over odd extensions."""
    n = design.settling(sections, tolerance)
    h = design.impulse(sections, n)
    start = design.initial_state(sections)

    def run(x: np.ndarray, at_rest: bool) -> np.ndarray:
        size = 1 << (len(x) + n - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]
        if not at_rest and len(x):
            # response to a constant before the start: what a settled state adds
            tail = design.sosfilt(sections, np.zeros(min(n, len(x))), start * x[0])[0]
            y[: len(tail)] += tail
        return y

    def causal(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        return run(x, not (steady and first))

    def both(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        pad = min(n, len(x) - 1) if len(x) > 1 else 0
        y = extend(x, pad, "odd") if pad else x
        y = run(run(y, False)[::-1], False)[::-1]
        return y[pad : pad + len(x)]

    return Kernel(both, 2 * n, 2 * n) if zero_phase else Kernel(causal, n, 0)


def fractional_delay(delay: float, radius: int = 16) -> Kernel:
    """Shift by a part of a sample through a windowed sinc."""
    t = np.arange(-radius, radius + 1)
    h = np.sinc(t - delay) * design.window("blackman_harris", 2 * radius + 1)
    return fir(h / h.sum(), centred=True)


def pointwise(f: Callable[[np.ndarray], np.ndarray]) -> Kernel:
    return Kernel(lambda x, first, last: f(x))


def subtract_template(template: Sequence[float], at: Sequence[int], max_lag: int = 8, dynamic: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """A template taken off at each event, moved to the best lag and scaled by least squares; events in order."""
    t = np.asarray(template, float)

    def apply(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        for a in at:
            lags = [d for d in range(-max_lag, max_lag + 1) if 0 <= a + d and a + d + len(t) <= len(y)]
            if not lags:
                continue
            d = max(lags, key=lambda q: (float(y[a + q : a + q + len(t)] @ t), -q))
            part = y[a + d : a + d + len(t)]
            part -= t * (max(0.0, float(part @ t) / float(t @ t)) if dynamic else 1.0)
        return y

    return apply


def halo(chain: Sequence[Kernel]) -> tuple[int, int]:
    return sum(k.left for k in chain), sum(k.right for k in chain)


def run(signal: DataFrame, chain: Sequence[Kernel], block: int = BLOCK) -> DataFrame:
    """ch, s, v after the chain, for each sample that is there. signal: ch, s, v; null values and samples missing in between count as zero."""
    left, right = halo(chain)
    # the number of samples: one number, for the true ends
    ends = signal.agg(F.min("s"), F.max("s")).first()
    if ends[0] is None:
        return signal.select(F.col("ch").cast("int"), F.col("s").cast("long"), F.col("v").cast("double"))
    lo, hi = ends
    window = lambda s: F.floor((s - lo) / block)
    spread = F.sequence(F.greatest(window(F.col("s") - right), F.lit(0)), F.least(window(F.col("s") + left), F.lit((hi - lo) // block)))
    read = signal.select("ch", "s", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), F.explode(spread).alias("win"))

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", kind="stable")
        s = rows["s"].to_numpy()
        a, b = max(lo, lo + key[1] * block - left), min(hi, lo + (key[1] + 1) * block - 1 + right)
        x = np.zeros(b - a + 1)
        x[s - a] = rows["v"].to_numpy()
        for k in chain:
            x = k.apply(x, bool(a <= lo), bool(b >= hi))
        own = s[(s >= lo + key[1] * block) & (s < lo + (key[1] + 1) * block)]
        return pd.DataFrame({"ch": np.full(len(own), key[0]), "s": own, "v": x[own - a]})

    return read.groupBy("ch", "win").applyInPandas(kernel, _LONG)


def iir_exact(signal: DataFrame, sections: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Causal recursive filter, exact at any block length.

    The state after a block is A^n times the state before it plus the block's own; the
    blocks' own states (two numbers a section) are folded per channel, and every block
    runs again from its true start.
    """
    size = 2 * len(sections)
    out_state = "ch int, win long, n long, z array<double>"
    cut = signal.select(F.col("ch").cast("int"), "s", F.col("v").cast("double"), F.floor(F.col("s") / block).alias("win"))

    def own(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("s", kind="stable")["v"].to_numpy()
        return pd.DataFrame([(key[0], key[1], len(x), design.sosfilt(sections, x)[1].ravel())], columns=["ch", "win", "n", "z"])

    def starts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        step = np.stack([design.sosfilt(sections, np.zeros(1), e.reshape(-1, 2))[1].ravel() for e in np.eye(size)], axis=1)
        z, out = np.zeros(size), []
        for r in rows.sort_values("win").itertuples():
            out.append((key[0], r.win, z.copy()))
            z = np.linalg.matrix_power(step, int(r.n)) @ z + np.asarray(r.z)
        return pd.DataFrame(out, columns=["ch", "win", "z"])

    states = cut.groupBy("ch", "win").applyInPandas(own, out_state).groupBy("ch").applyInPandas(starts, "ch int, win long, z array<double>")

    def again(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", kind="stable")
        y = design.sosfilt(sections, rows["v"].to_numpy(), np.asarray(state["z"].iloc[0]).reshape(-1, 2))[0]
        return pd.DataFrame({"ch": rows["ch"], "s": rows["s"], "v": y})

    return cut.groupBy("ch", "win").cogroup(states.groupBy("ch", "win")).applyInPandas(again, _LONG)


def resample(signal: DataFrame, up: int, down: int, block: int = BLOCK) -> DataFrame:
    """Rational resampling by a polyphase filter, zeros outside; s counts samples of the new rate from 0."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return signal
    taps, half = design.resample_taps(up, down)
    reach = -(-half // up) + 1
    last = signal.agg(F.max("s")).first()[0]
    if last is None:
        return signal
    total = -(-(last + 1) * up // down)
    # input s reaches outputs m with |m * down - s * up| <= half
    low, high = F.floor((F.col("s") * up - half) / down), F.floor((F.col("s") * up + half) / down) + 1
    spread = F.sequence(F.floor(F.greatest(low, F.lit(0)) / block), F.floor(F.greatest(F.least(high, F.lit(total - 1)), F.lit(0)) / block))
    read = signal.select("ch", "s", F.col("v").cast("double").alias("v"), F.explode(spread).alias("win"))

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.arange(key[1] * block, min((key[1] + 1) * block, total))
        base = int(rows["s"].min()) - reach
        x = np.zeros(int(rows["s"].max()) + reach + 1 - base + 1)
        x[rows["s"].to_numpy() - base] = rows["v"].to_numpy()
        centre = m * down
        first = -(-(centre - half) // up)
        y = np.zeros(len(m))
        for j in range(2 * half // up + 2):
            s = first + j
            k = centre - s * up + half
            good = (k >= 0) & (k <= 2 * half) & (s - base >= 0) & (s - base < len(x))
            y[good] += taps[k[good]] * x[s[good] - base]
        return pd.DataFrame({"ch": np.full(len(m), key[0]), "s": m, "v": y})

    return read.groupBy("ch", "win").applyInPandas(kernel, _LONG)


def decimate(signal: DataFrame, q: int, rate: float, zero_phase: bool = True, block: int = BLOCK) -> DataFrame:
    """Every q-th sample after a Chebyshev low-pass of order 8 at 0.8 of the new half rate, or an FIR of 20 q + 1 taps."""
    if zero_phase:
        kernel = iir(design.iir("chebyshev1", 8, "lowpass", [0.8 * rate / 2 / q], rate, 0.05), zero_phase=True)
    else:
        kernel = fir(design.firwin(20 * q + 1, 1 / q), centred=True)
    return run(signal, [kernel], block).where(F.col("s") % q == 0).withColumn("s", (F.col("s") / q).cast("long"))


def measure(signal: DataFrame, length: int, fn: Callable[[np.ndarray], dict[str, float]], schema: str, rate: float = 1.0) -> DataFrame:
    """A row per window of a frame signal: fn gets [channels, samples] and returns the same keys for each window."""

    def apply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", kind="stable")
        got = fn(np.stack(rows["v"].to_list(), axis=1))
        return pd.DataFrame([{"start_s": key[0] * length / rate, "stop_s": (key[0] * length + len(rows)) / rate, **got}])

    return signal.select("s", "v", F.floor(F.col("s") / length).alias("win")).groupBy("win").applyInPandas(apply, f"start_s double, stop_s double, {schema}")


def transform(signal: DataFrame, fn: Callable[[np.ndarray], np.ndarray], left: int = 0, right: int = 0, block: int = BLOCK) -> DataFrame:
    """A caller's function of a channel's window that keeps its length, with a halo."""
    return run(signal, [Kernel(lambda x, first, last: fn(x), left, right)], block)
