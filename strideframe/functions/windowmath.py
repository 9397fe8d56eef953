"""Small NumPy helpers on stacked windows ``[windows, rows]``; used inside tasks only."""

from __future__ import annotations

import warnings

import numpy as np


def fill_both(a: np.ndarray) -> np.ndarray:
    """Linear interpolation along the last axis, ends take the nearest valid value."""
    n = a.shape[-1]
    ok = np.isfinite(a)
    if n == 0 or ok.all():
        return a
    place = np.broadcast_to(np.arange(n), a.shape)
    before = np.maximum.accumulate(np.where(ok, place, -1), axis=-1)
    after = np.minimum.accumulate(np.where(ok, place, n)[..., ::-1], axis=-1)[..., ::-1]
    low, high = np.where(before < 0, after, before), np.where(after >= n, before, after)
    none = (low >= n) | (high < 0)
    low, high = np.where(none, 0, low), np.where(none, 0, high)
    v0, v1 = np.take_along_axis(a, low, -1), np.take_along_axis(a, high, -1)
    gap = np.where(high > low, high - low, 1)
    return np.where(ok, a, np.where(none, np.nan, v0 + (v1 - v0) / gap * (place - low)))


def stat_block(values: np.ndarray) -> np.ndarray:
    """mean, median, population std, min, max, range, q25, q75 along the last axis, NaN skipped."""
    if values.shape[-1] == 0:
        return np.full((*values.shape[:-1], 8), np.nan)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        q25, q50, q75 = np.nanpercentile(values, [25, 50, 75], axis=-1)
        low, high = np.nanmin(values, axis=-1), np.nanmax(values, axis=-1)
        return np.stack(
            [np.nanmean(values, axis=-1), q50, np.nanstd(values, axis=-1), low, high, high - low, q25, q75], axis=-1
        )


def spectrum(a: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Magnitude sum, dominant frequency without DC, centroid over the first half of the DFT."""
    n = a.shape[-1]
    half = np.abs(np.fft.fft(a, axis=-1))[..., : n // 2]
    freq = np.arange(n // 2) * (np.asarray(fps)[..., None] / n)
    with np.errstate(invalid="ignore", divide="ignore"):
        energy = half.sum(axis=-1)
        centroid = np.where(energy > 0, (freq * half).sum(axis=-1) / np.where(energy > 0, energy, 1), 0.0)
    dominant = np.zeros(energy.shape)
    if n // 2 > 1:
        live = (half[..., 1:] > 0).any(axis=-1)
        peak = np.argmax(np.nan_to_num(half[..., 1:]), axis=-1) + 1
        dominant = np.where(live, np.take_along_axis(freq, peak[..., None], -1)[..., 0], 0.0)
    return np.stack([energy, dominant, centroid], axis=-1)


def axis_features(a: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Six features of zero-filled or complete series ``[windows, rows]``."""
    if a.shape[-1] < 2:
        return np.zeros((*a.shape[:-1], 6))
    v = np.diff(a, axis=-1) * np.asarray(fps)[..., None]
    motion = np.stack([np.abs(v).mean(axis=-1), v.std(axis=-1), a.max(axis=-1) - a.min(axis=-1)], axis=-1)
    return np.concatenate([motion, spectrum(a, fps)], axis=-1)


def joint_angles(p1: np.ndarray, centre: np.ndarray, p3: np.ndarray) -> np.ndarray:
    """Angles in degrees for stacked points ``[..., 2]``; NaN for arms under 1e-6."""
    a, b = p1 - centre, p3 - centre
    na, nb = np.linalg.norm(a, axis=-1), np.linalg.norm(b, axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.clip((a * b).sum(axis=-1) / (na * nb), -1.0, 1.0)
        return np.where((na < 1e-6) | (nb < 1e-6), np.nan, np.degrees(np.arccos(c)))


def angle_features(angles: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """mean, std, mean absolute change, std of change of zero-filled angle series."""
    a = np.nan_to_num(fill_both(angles))
    d = np.diff(a, axis=-1) * np.asarray(fps)[..., None] if a.shape[-1] > 1 else np.zeros((*a.shape[:-1], 1))
    return np.stack([a.mean(axis=-1), a.std(axis=-1), np.abs(d).mean(axis=-1), d.std(axis=-1)], axis=-1)
