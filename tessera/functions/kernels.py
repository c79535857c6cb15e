"""Numeric kernels on planes and waveforms, as Arrow-batched pandas UDFs over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def box_blur(plane: np.ndarray, size: int = 5) -> np.ndarray:
    """Mean over size x size with edges repeated, by two running sums."""
    pad = size // 2
    for axis in (0, 1):
        wide = np.pad(plane, [(pad, pad) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        total = np.cumsum(wide, axis=axis)
        total = np.insert(total, 0, 0, axis=axis)
        n = plane.shape[axis]
        plane = (np.take(total, range(size, size + n), axis) - np.take(total, range(n), axis)) / size
    return plane


def residual_plane(plane: np.ndarray) -> np.ndarray:
    """What two blurs leave, without row and column means, scaled to unit deviation (zeros where flat)."""
    r = plane - box_blur(box_blur(plane))
    r = r - r.mean(1, keepdims=True)
    r = r - r.mean(0, keepdims=True)
    s = r.std()
    return r / s if s > 1e-9 else np.zeros_like(r)


def blockiness_of(plane: np.ndarray, block: int = 8) -> float:
    """Mean step across block edges over the mean step elsewhere; 1 where there is nothing to compare."""
    dx, dy = np.abs(np.diff(plane, axis=1)), np.abs(np.diff(plane, axis=0))
    ex, ey = np.arange(dx.shape[1]) % block == block - 1, np.arange(dy.shape[0]) % block == block - 1
    edge, rest = np.concatenate([dx[:, ex].ravel(), dy[ey].ravel()]), np.concatenate([dx[:, ~ex].ravel(), dy[~ey].ravel()])
    return float(edge.mean() / rest.mean()) if edge.size and rest.size and rest.mean() > 1e-12 else 1.0


def mel_filters(bands: int, n_fft: int, rate: int) -> np.ndarray:
    """(bands, n_fft / 2 + 1) triangles, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


def audio_descriptor_of(wave: np.ndarray, rate: int = 16000, bands: int = 40, n_fft: int = 512) -> np.ndarray:
    """Means and deviations of log mel energies, then the root mean square and the rate of sign changes."""
    if len(wave) < n_fft:
        wave = np.pad(wave, (0, n_fft - len(wave)))
    hop = n_fft // 2
    frames = np.lib.stride_tricks.sliding_window_view(wave, n_fft)[::hop] * np.hanning(n_fft)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    log = np.log(power @ mel_filters(bands, n_fft, rate).T + 1e-10)
    turns = np.mean(np.abs(np.diff(np.signbit(wave).astype(np.int8))))
    return np.concatenate([log.mean(0), log.std(0), [np.sqrt(np.mean(wave**2)), turns]])


def _plane(values, height: int) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(height, -1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def residual(values: pd.Series, height: pd.Series) -> pd.Series:
    """The residual of a row-major plane."""
    return pd.Series([None if v is None else residual_plane(_plane(v, h)).ravel() for v, h in zip(values, height)])


@F.pandas_udf(T.DoubleType())
def blockiness(values: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else blockiness_of(_plane(v, h)) for v, h in zip(values, height)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def audio_descriptor(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else audio_descriptor_of(np.asarray(v, np.float64)) for v in values])
