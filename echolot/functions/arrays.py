"""Arrow functions over columns of samples: the numpy signal code for whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dsp

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it; elsewhere pass it by --py-files."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def _of(kind: str, f: Callable, *columns: Column | str) -> Column:
    """f of each row's arrays; null where one of them is null."""
    def run(*cols: pd.Series) -> pd.Series:
        rows = [None if any(x is None for x in row) else f(*(np.asarray(x, float) for x in row)) for row in zip(*cols, strict=True)]
        return pd.Series(rows, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def split_points(values: Column | str, pieces: int) -> Column:
    """Places from 0 at which to split."""
    return _of("array<int>", lambda x: np.asarray(dsp.split_points(x, pieces), np.int32), values)


def band_energy_minima(values: Column | str, fs: float, low: float, high: float, width: int, pieces: int) -> Column:
    """W13"""
    return _of("array<int>", lambda x: np.asarray(dsp.band_energy_minima(x, fs, low, high, width, pieces), np.int32), values)


def silent(values: Column | str, fs: float, least_s: float, window_s: float = 0.02) -> Column:
    """Whether each sample is silent."""
    return _of("array<boolean>", lambda x: dsp.silent_mask(x, fs, least_s, window_s), values)


def changes(values: Column | str, penalty: float) -> Column:
    """Places from 0 at which the mean changes."""
    return _of("array<int>", lambda x: np.asarray(dsp.mean_changes(x, penalty), np.int32), values)


def event_segments(values: Column | str, fs: float, smooth_s: float, overlap_s: float, penalty: float = 10.0, windows_s: tuple[float, float] = (1.0, 60.0)) -> Column:
    """[first, last] sample, from 1, of each segment."""
    return _of("array<array<int>>", lambda x: [np.asarray(p, np.int32) for p in dsp.event_segments(x, fs, smooth_s, overlap_s, penalty, windows_s)], values)


def mel_spectrum(values: Column | str, fs: float, window: int, hop: int, low: float, high: float, bands: int = 40) -> Column:
    """For each frame the power of the bands."""
    return _of("array<array<double>>", lambda x: list(dsp.mel_spectrum(x, fs, window, hop, low, high, bands)), values)


def resample(values: Column | str, fs: float, to: float) -> Column:
    """X13"""
    return _of("array<double>", lambda x: dsp.resample(x, fs, to), values)


def band_pass(values: Column | str, fs: float, low: float | None, high: float | None) -> Column:
    """X14"""
    return _of("array<double>", lambda x: dsp.band_pass(x, fs, low, high) if len(x) else x, values)


def lag_of_best_match(a: Column | str, b: Column | str) -> Column:
    """X28"""
    return _of("int", dsp.lag_of_best_match, a, b)


def recycle(values: Column | str, n: Column | int) -> Column:
    """Forth and back until n long, in the JVM."""
    v, n = (F.col(values) if isinstance(values, str) else values), (F.lit(n) if isinstance(n, int) else n)
    both = F.concat(v, F.reverse(v))
    return F.when(F.size(v) > 0, F.slice(F.flatten(F.array_repeat(both, F.ceil(n / F.size(both)).cast("int"))), F.lit(1), n.cast("int")))
