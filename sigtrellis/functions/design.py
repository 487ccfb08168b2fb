"""Filter design in numpy: second-order sections, FIR taps and windows. Runs on the driver; results are a few numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def _zpk_sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) from zeros, poles and gain; poles nearest the circle come last with the zeros nearest them."""
    z, p = list(np.asarray(z, complex)), list(np.asarray(p, complex))
    z += [0j] * (len(p) - len(z))
    if len(p) % 2:
        z.append(0j)
        p.append(0j)

    def take(pool: list, i: int) -> tuple[complex, complex]:
        """A value with its conjugate, or with the real one nearest to it."""
        a = pool.pop(i)
        if abs(a.imag) > 1e-12:
            j = min(range(len(pool)), key=lambda q: abs(pool[q] - a.conjugate()))
        else:
            real = [q for q in range(len(pool)) if abs(pool[q].imag) <= 1e-12]
            j = min(real, key=lambda q: abs(pool[q] - a))
        return a, pool.pop(j)

    out = []
    while p:
        a, b = take(p, min(range(len(p)), key=lambda i: abs(1 - abs(p[i]))))
        c, d = take(z, min(range(len(z)), key=lambda i: abs(z[i] - a)))
        out.append([1.0, (-c - d).real, (c * d).real, 1.0, (-a - b).real, (a * b).real])
    sections = np.array(out[::-1])
    sections[0, :3] *= k
    return sections


def _prototype(kind: str, order: int, ripple: float | None) -> tuple[np.ndarray, float]:
    """Poles and gain of the analogue low-pass of cut-off 1."""
    m = np.arange(-order + 1, order, 2)
    if kind == "butterworth":
        return -np.exp(1j * np.pi * m / (2 * order)), 1.0
    if kind == "chebyshev1":
        if ripple is None:
            raise ValueError("chebyshev1 needs ripple")
        eps = math.sqrt(10 ** (0.1 * ripple) - 1)
        p = -np.sinh(np.arcsinh(1 / eps) / order + 1j * np.pi * m / (2 * order))
        return p, float(np.prod(-p).real) / (math.sqrt(1 + eps * eps) if order % 2 == 0 else 1.0)
    if kind == "bessel":
        # reverse Bessel polynomial, scaled so that its phase is that of the Butterworth filter at high frequencies
        c = [math.factorial(2 * order - i) / (2 ** (order - i) * math.factorial(i) * math.factorial(order - i)) for i in range(order + 1)]
        p = np.roots(c[::-1]) / c[0] ** (1 / order)
        return p, float(np.prod(-p).real)
    raise ValueError(f"no design called {kind}")


def iir(kind: str, order: int, band: str, freqs: Sequence[float], rate: float, ripple: float | None = None) -> np.ndarray:
    """Digital sections by the bilinear transform; band: lowpass, highpass, bandpass, bandstop."""
    freqs = [float(f) for f in np.atleast_1d(freqs)]
    if any(not 0 < f < rate / 2 for f in freqs) or (band in ("bandpass", "bandstop")) != (len(freqs) == 2):
        raise ValueError("iir: frequencies have to lie between 0 and half the rate, two for a band")
    p, k = _prototype(kind, order, ripple)
    z = np.array([], complex)
    w = [4 * math.tan(math.pi * f / rate) for f in freqs]  # prewarped for a sample distance of 1/2
    n = len(p)
    if band == "lowpass":
        z, p, k = z * w[0], p * w[0], k * w[0] ** n
    elif band == "highpass":
        k = k * float(np.real(np.prod(-z) / np.prod(-p)))
        z, p = np.zeros(n, complex), w[0] / p
    else:
        bw, w0 = w[1] - w[0], math.sqrt(w[0] * w[1])
        if band == "bandpass":
            s = p * bw / 2
            p = np.concatenate([s + np.sqrt(s * s - w0 * w0), s - np.sqrt(s * s - w0 * w0)])
            z, k = np.zeros(n, complex), k * bw**n
        elif band == "bandstop":
            k = k * float(np.real(1 / np.prod(-p)))
            s = bw / 2 / p
            p = np.concatenate([s + np.sqrt(s * s - w0 * w0), s - np.sqrt(s * s - w0 * w0)])
            z = np.concatenate([np.full(n, 1j * w0), np.full(n, -1j * w0)])
        else:
            raise ValueError(f"no band called {band}")
    missing = len(p) - len(z)
    k = k * float(np.real(np.prod(4 - z) / np.prod(4 - p)))
    return _zpk_sections(np.concatenate([(4 + z) / (4 - z), -np.ones(missing)]), (4 + p) / (4 - p), k)


def notch(freq: float, q: float, rate: float) -> np.ndarray:
    """One section that removes a frequency; q is the frequency over the width."""
    w0 = 2 * math.pi * freq / rate
    g = 1 / (1 + math.tan(w0 / (2 * q)))
    c = math.cos(w0)
    return np.array([[g, -2 * g * c, g, 1.0, -2 * g * c, 2 * g - 1]])


def checked(sections: Sequence[Sequence[float]]) -> np.ndarray:
    """Sections given by hand: finite, a0 = 1, poles inside the circle."""
    s = np.asarray(sections, float)
    if s.ndim != 2 or s.shape[1] != 6 or not np.isfinite(s).all() or (s[:, 3] != 1).any():
        raise ValueError("sections: finite rows of six with a0 = 1")
    if any(abs(np.roots(r[3:])).max(initial=0) >= 1 for r in s):
        raise ValueError("sections: a pole isn't inside the unit circle")
    return s


def initial_state(sections: np.ndarray) -> np.ndarray:
    """State of each section after a constant 1 has settled."""
    out, gain = np.zeros((len(sections), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        out[i] = gain * (y - b0), gain * (b2 - a2 * y)
        gain *= y
    return out


def sosfilt(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transposed direct form II over the last axis, all channels at once; returns the output and the state after it."""
    y = np.array(x, float)
    z = np.zeros((len(sections), 2, *y.shape[:-1])) if state is None else np.array(state, float)
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        z0, z1 = z[i]
        for t in range(y.shape[-1]):
            v = y[..., t].copy()
            o = b0 * v + z0
            z0 = b1 * v - a1 * o + z1
            z1 = b2 * v - a2 * o
            y[..., t] = o
        z[i] = z0, z1
    return y, z


def impulse(sections: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros(n)
    x[0] = 1.0
    return sosfilt(sections, x)[0]


def settling(sections: np.ndarray, tolerance: float = 2.0**-23, most: int = 1 << 20) -> int:
    """First sample from which what is left of the impulse response sums to a share of the whole."""
    radius = max(abs(np.roots(r[3:])).max(initial=0) for r in sections)
    n = 64 if radius == 0 else int(min(most, max(64, math.ceil(math.log(tolerance * 1e-3) / math.log(min(radius, 1 - 1e-9))) * 2)))
    h = np.abs(impulse(sections, n))
    rest = h.sum() - np.cumsum(h)
    return int(np.argmax(rest <= tolerance * h.sum())) + 1


def kaiser(n: int, beta: float) -> np.ndarray:
    return np.kaiser(n, beta)


def window(name: str, n: int, beta: float = 5.0, sigma: float = 0.4) -> np.ndarray:
    """Symmetric windows: hann, hamming, kaiser, gaussian, blackman_harris."""
    t = np.arange(n) / max(1, n - 1)
    if name == "gaussian":
        return np.exp(-0.5 * ((t - 0.5) * 2 / sigma) ** 2)
    if name == "blackman_harris":
        return sum(a * (-1) ** i * np.cos(2 * np.pi * i * t) for i, a in enumerate((0.35875, 0.48829, 0.14128, 0.01168)))
    return {"hann": np.hanning, "hamming": np.hamming, "kaiser": lambda m: np.kaiser(m, beta)}[name](n)


def firwin(n: int, cutoff: float, beta: float = 5.0) -> np.ndarray:
    """Low-pass taps with a cut-off as a share of half the rate, Kaiser window, gain 1 at zero."""
    m = np.arange(n) - (n - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.kaiser(n, beta)
    return h / h.sum()


def resample_taps(up: int, down: int) -> tuple[np.ndarray, int]:
    """Taps of the polyphase filter and half their length."""
    half = 10 * max(up, down)
    return firwin(2 * half + 1, 1 / max(up, down)) * up, half


def haar(x: np.ndarray, levels: int) -> np.ndarray:
    """Coefficients of the Haar transform, coarsest first."""
    x, out = np.asarray(x, float), []
    for _ in range(levels):
        if len(x) < 2:
            break
        even, odd = x[0 : len(x) // 2 * 2 : 2], x[1 : len(x) // 2 * 2 : 2]
        out.insert(0, (even - odd) / math.sqrt(2))
        x = (even + odd) / math.sqrt(2)
    return np.concatenate([x, *out])
