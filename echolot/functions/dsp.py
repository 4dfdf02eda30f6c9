"""Signal processing in numpy, called from Arrow functions: spectra, mel bands, resampling, filters, splitting."""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np


@functools.lru_cache(maxsize=16)
def hamming(n: int) -> np.ndarray:
    """Periodic."""
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def stft_power(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """X11: rows of |FFT|^2, half a window of zeros at both ends, FFT of 4 * 2**ceil(log2(window)) points."""
    n_fft = 4 * 2 ** int(np.ceil(np.log2(window)))
    pad = np.zeros(window // 2)
    y = np.concatenate([pad, np.asarray(x, float), pad])
    if len(y) < window:
        return np.zeros((0, n_fft // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(y, window)[::hop]
    return np.abs(np.fft.rfft(frames * hamming(window), n_fft, axis=1)) ** 2


@functools.lru_cache(maxsize=16)
def mel_bank(n_fft: int, fs: float, low: float, high: float, bands: int = 40) -> np.ndarray:
    """Triangles of equal width on the mel scale, normalised by bandwidth."""
    mel, hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(mel(low), mel(high), bands + 2))
    f = np.arange(n_fft // 2 + 1) * fs / n_fft
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_spectrum(x: np.ndarray, fs: float, window: int, hop: int, low: float, high: float, bands: int = 40) -> np.ndarray:
    p = stft_power(x, window, hop)
    return p @ mel_bank(2 * (p.shape[1] - 1), fs, low, high, bands).T


@functools.lru_cache(maxsize=16)
def _low_pass(up: int, down: int) -> np.ndarray:
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    return up / most * np.sinc(t / most) * np.kaiser(2 * half + 1, 5.0)


def resample(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """By the ratio of small integers nearest to to / fs, through a windowed sinc."""
    r = Fraction(to / fs).limit_denominator(10_000)
    if r == 1:
        return np.asarray(x, float)
    y = np.zeros(len(x) * r.numerator)
    y[:: r.numerator] = x
    h = _low_pass(r.numerator, r.denominator)
    n = -(-len(x) * r.numerator // r.denominator)
    full = np.convolve(y, h)[len(h) // 2 :: r.denominator]
    return full[:n]


def band_pass(x: np.ndarray, fs: float, low: float | None, high: float | None) -> np.ndarray:
    """Zero-phase, by a raised-cosine mask of a tenth of the cut-off in the spectrum."""
    x = np.asarray(x, float)
    s, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / fs)
    g = np.ones_like(f)
    if high:
        g *= np.clip((1.1 * high - f) / (0.1 * high), 0, 1)
    if low:
        g *= np.clip((f - 0.9 * low) / (0.1 * low), 0, 1)
    return np.fft.irfft(s * np.sin(g * np.pi / 2) ** 2, len(x))


def silent_mask(x: np.ndarray, fs: float, least_s: float, window_s: float = 0.02) -> np.ndarray:
    """Samples in runs of at least least_s whose RMS lies 3 MAD of its logarithm under the median, zeros left aside.

    The threshold is at least a millionth of the loudest window; runs no further apart than a window become one. All if
    all is zero, none if it would be all.
    """
    x = np.asarray(x, float)
    n = max(2 * round(window_s * fs / 2), 2)
    if len(x) < n:
        return np.zeros(len(x), bool)
    hop = n // 2
    rms = np.sqrt((np.lib.stride_tricks.sliding_window_view(x, n)[::hop] ** 2).mean(1))
    some = rms[rms > 0]
    if not len(some):
        return np.ones(len(x), bool)
    level = np.log10(some + np.finfo(float).eps)
    mid = np.median(level)
    low = rms < max(10 ** (mid - 3 * np.median(np.abs(level - mid))), some.max() * 1e-6)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(int), [0]]))).reshape(-1, 2)
    # from 0, ends exclusive; a run up to the last window reaches to the last sample
    runs = [(a * hop, len(x) if b == len(low) else min(b * hop + n - 1, len(x))) for a, b in edges.tolist()]
    out, last = np.zeros(len(x), bool), None
    for a, b in (r for r in runs if r[1] - r[0] >= least_s * fs):
        out[last if last is not None and a + 1 - last <= n else a : b] = True
        last = b
    return np.zeros(len(x), bool) if out.all() else out


def mean_changes(x: np.ndarray, penalty: float) -> list[int]:
    """Places where the mean changes, of least squared error plus penalty a change (pruned exact search)."""
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(np.square(x))])
    best, last, alive = np.zeros(n + 1), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for t in range(1, n + 1):
        cost = best[alive] + (q[t] - q[alive]) - (s[t] - s[alive]) ** 2 / (t - alive) + penalty
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k], alive[k]
        alive = np.append(alive[cost - penalty <= best[t]], t)
    out, t = [], n
    while last[t]:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def moving_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Over n samples around each, one more before than after if n is even; fewer at the ends."""
    c, i = np.concatenate([[0.0], np.cumsum(x)]), np.arange(len(x))
    a, b = np.maximum(i - n // 2, 0), np.minimum(i + (n - 1) // 2 + 1, len(x))
    return (c[b] - c[a]) / (b - a)


def extreme_score(x: np.ndarray) -> float:
    """A17 of one envelope, as metrics.extreme_score has it."""
    db = 20 * np.log10(np.asarray(x, float) + 2.0**-52)
    low, q1, q3, high = np.percentile(db, [0.1, 25, 75, 99.9], method="hazen")
    var, d = (float(np.var(db, ddof=1)) if len(db) > 1 else 0.0), db - db.mean()
    m2 = float(np.mean(d**2))
    skew, kurt = (float(np.mean(d**3)) / m2**1.5, float(np.mean(d**4)) / m2**2) if m2 else (0.0, 0.0)
    spread = (high - low) / (q3 - q1) if q3 > q1 else np.inf if high > low else 0.0
    above = lambda v, least, unit: max((v - least) / unit, 0.0)
    return (0.35 * min(var / 15, 5.0) + 0.25 * above(var**0.5, 3, 2) + 0.15 * above(float(np.ptp(db)), 25, 15) + 0.1 * above(skew, 1, 3)
            + 0.1 * above(kurt, 4, 5) + 0.03 * above(spread, 4, 3) + 0.02 * abs(float(db.mean() - np.median(db))) / 2)


def event_segments(x: np.ndarray, fs: float, smooth_s: float, overlap_s: float, penalty: float = 10.0, windows_s: tuple[float, float] = (1.0, 60.0)) -> list[tuple[int, int]]:
    """First and last sample, from 1, of the segments between changes of the envelope; one segment where nothing is extreme.

    The envelope of the short window is taken where it is extreme, else that of the long one. All segments but the last
    reach overlap_s into the next; the last ends one sample before the end. Silence and empty sound are one segment.
    """
    x = np.asarray(x, float)
    y = band_pass(x - x.mean(), fs, 5.0, None) if len(x) else x
    top = np.abs(y).max(initial=0.0)
    env = None
    if top > 0:
        for w in windows_s:
            e = np.sqrt(np.maximum(moving_mean((y / top) ** 2, max(round(w * fs), 1)), 0.0))
            if extreme_score(e) > 0.75:
                env = e
                break
    if env is None:
        return [(1, len(x))]
    bounds = np.unique([1, *(k + 1 for k in mean_changes(moving_mean(env, max(round(smooth_s * fs), 1)), penalty)), len(x)]).tolist()
    extra = round(overlap_s * fs)
    ends = [min(b - 1 + extra, len(x)) for b in bounds[1:-1]] + [bounds[-1] - 1]
    return list(zip(bounds[:-1], ends, strict=True))


def split_points(prob: np.ndarray, pieces: int) -> list[int]:
    """For each ideal border the nearest unused local minimum; indices from 0."""
    low = np.flatnonzero((prob[1:-1] <= prob[:-2]) & (prob[1:-1] <= prob[2:])) + 1
    out: list[int] = []
    for k in range(1, pieces):
        left = [i for i in low.tolist() if i not in out]
        if left:
            ideal = k * (len(prob) - 1) / pieces
            out.append(min(left, key=lambda i: (abs(i - ideal), i)))
    return sorted(out)


def band_energy_minima(x: np.ndarray, fs: float, low: float, high: float, width: int, pieces: int) -> list[int]:
    """As split_points, on the smoothed energy of a band."""
    e = np.convolve(band_pass(x, fs, low, high) ** 2, np.ones(width) / width, "same")
    return split_points(e, pieces)


def lag_of_best_match(a: np.ndarray, b: np.ndarray) -> int:
    """How far b lies behind a at the largest cross-correlation."""
    n = len(a) + len(b) - 1
    c = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    k = int(np.argmax(c))
    return k if k < len(a) else k - n


def recycle(noise: np.ndarray, n: int) -> np.ndarray:
    """Noise forth and back until it is n long."""
    both = np.concatenate([noise, noise[::-1]])
    return np.tile(both, -(-n // len(both)))[:n]


def mix_at_snr(signal: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """X22"""
    ps, pn = float(np.mean(np.square(signal))), float(np.mean(np.square(noise)))
    gain = np.sqrt(pn * 10 ** (snr_db / 10) / ps) if ps else 0.0
    return gain * signal + noise


def call_sequence(calls: list[np.ndarray], noise: np.ndarray, fs: int, apart_s: float, snr: tuple[float, float], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """G1: calls placed apart over noise, and the mask of where they are."""
    from ..operators.matching import place_apart

    rng = np.random.default_rng(seed)
    out, mask = noise.astype(float).copy(), np.zeros(len(noise), np.int8)
    pn = float(np.mean(np.square(noise)))
    for call, (a, b) in zip(sorted(calls, key=len, reverse=True), sorted(place_apart(sorted((len(c) for c in calls), reverse=True), len(noise), round(apart_s * fs), seed), key=lambda p: p[0] - p[1]), strict=False):
        c = call[: b - a + 1]
        gain = np.sqrt(pn * 10 ** (rng.uniform(*snr) / 10) / max(float(np.mean(np.square(c))), 1e-30))
        out[a - 1 : a - 1 + len(c)] += gain * c
        mask[a - 1 : a - 1 + len(c)] = 1
    return out / max(np.abs(out).max(), 1e-12), mask
