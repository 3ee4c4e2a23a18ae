"""Sample-array expressions for short waveforms held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clipalign.functions.scalars import uniform


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def log_offset(wave: Column, eps: float = 1e-6) -> Column:
    return F.transform(wave, lambda x: F.ln(x + F.lit(eps)))


def standardize(wave: Column, mean: float, std: float) -> Column:
    """Shift by the mean and divide by twice the deviation."""
    return F.transform(wave, lambda x: (x - F.lit(mean)) / F.lit(2 * std))


def pad_or_truncate(wave: Column, length: int, fill: float = 0.0) -> Column:
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(wave))
    return F.slice(F.concat(wave, F.array_repeat(F.lit(float(fill)), missing)), 1, length)


def gain(wave: Column, factor: float) -> Column:
    return F.transform(wave, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.lit(factor))))


def add_noise(wave: Column, amplitude: float, seed: str, key: Column) -> Column:
    """Add Gaussian noise of the given amplitude, repeatable per key and position (Box-Muller)."""

    def noisy(x: Column, i: Column) -> Column:
        first = F.lit(1.0) - uniform(f"{seed}:a", key, i)
        second = uniform(f"{seed}:b", key, i)
        return x + F.lit(amplitude) * F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(6.283185307179586) * second)

    return F.transform(wave, noisy)
