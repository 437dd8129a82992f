"""Gradient noise on a hashed lattice, vectorised over Arrow batches.

The lattice hash is plain modular integer arithmetic, so every engine can reproduce it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_P = 2147483647
_GX = np.array([1.0, -1.0, 1.0, -1.0, 1.0, -1.0, 0.0, 0.0])
_GZ = np.array([1.0, 1.0, -1.0, -1.0, 0.0, 0.0, 1.0, -1.0])


def seed_of(text: Column) -> Column:
    """31-bit number of a named seed channel."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % _P


def uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) that depends only on the given parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def _direction(ix, iz, seed):
    v = np.mod(ix * 374761393 + iz * 668265263 + seed * 1274126177, _P)
    for k in (12345, 54321):
        v = np.mod(v * v + k, _P)
    return v >> 28


def lattice_noise(x: np.ndarray, z: np.ndarray, seed: np.ndarray) -> np.ndarray:
    fx, fz = np.floor(x), np.floor(z)
    ix, iz = fx.astype(np.int64), fz.astype(np.int64)
    dx, dz = x - fx, z - fz

    def corner(ox, oz):
        g = _direction(ix + ox, iz + oz, seed)
        return _GX[g] * (dx - ox) + _GZ[g] * (dz - oz)

    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    u, v = fade(dx), fade(dz)
    north = corner(0, 0) + u * (corner(1, 0) - corner(0, 0))
    south = corner(0, 1) + u * (corner(1, 1) - corner(0, 1))
    return north + v * (south - north)


def fbm_np(x, z, seed, frequency, amplitude, octaves=4, anisotropy=1.0):
    total, norm, amp, f = np.zeros_like(x), 0.0, 1.0, frequency
    for _ in range(octaves):
        total = total + amp * lattice_noise(x * f, z * f * anisotropy, seed)
        norm, f, amp = norm + amp, f * 2.0, amp * 0.5
    return amplitude * total / norm


def ridged_np(x, z, seed, frequency, amplitude, octaves=4):
    total, norm, amp, f, weight = np.zeros_like(x), 0.0, 1.0, frequency, np.ones_like(x)
    for _ in range(octaves):
        n = (1.0 - np.abs(lattice_noise(x * f, z * f, seed))) ** 2 * weight
        weight = np.clip(n * 2.0, 0.0, 1.0)
        total = total + amp * n
        norm, f, amp = norm + amp, f * 2.0, amp * 0.5
    return amplitude * (total / norm * 2 - 1)


def warped_np(x, z, seed, warp_seed, frequency, amplitude, strength, warp_frequency, octaves=4):
    wx = lattice_noise(x * warp_frequency, z * warp_frequency, warp_seed) * strength
    wz = lattice_noise(x * warp_frequency + 137.17, z * warp_frequency - 91.31, warp_seed) * strength
    return fbm_np(x + wx, z + wz, seed, frequency, amplitude, octaves)


@F.pandas_udf(DoubleType())
def fbm(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Four-octave noise at ``x, z`` for a numeric seed, frequency and amplitude."""
    for x, z, seed, freq, amp in batches:
        yield pd.Series(fbm_np(x.to_numpy(float), z.to_numpy(float), seed.to_numpy(np.int64),
                               freq.to_numpy(float), amp.to_numpy(float)))
