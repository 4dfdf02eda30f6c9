"""Training sequences from calls and noise, and pairs of features and masks made of them.

Sequences are made a row at a time by Arrow functions. What is random depends on the seed and the row's id alone, so a
task that runs again makes the same sequence and no order of rows is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dsp
from . import framing

Made = tuple[np.ndarray, np.ndarray]


def generator(seed: int, key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def at_full_scale(x: np.ndarray, level: float) -> np.ndarray:
    top = np.abs(x).max() if len(x) else 0.0
    return x / top * level if top else x


def gain(call: np.ndarray, noise: np.ndarray, snr_db: float) -> float:
    """The factor that lifts a call to snr_db over the noise; 0 for a silent call."""
    power = float(np.mean(np.square(call)))
    return float(np.sqrt(np.mean(np.square(noise)) * 10 ** (snr_db / 10) / power)) if power else 0.0


def single_call(call: np.ndarray, noise: np.ndarray, fs: float, band: tuple[float, float], snr: tuple[float, float], rng: np.random.Generator) -> Made:
    """One call anywhere in noise of three times its length; its level is set within the band against the noise under it."""
    n = len(call)
    bed = dsp.recycle(noise, 3 * n)
    at = int(rng.integers(0, 2 * n + 1))
    under = slice(at, at + n)
    k = gain(dsp.band_pass(call, fs, *band), dsp.band_pass(bed[under], fs, *band), rng.uniform(*snr))
    out, mask = bed.astype(float).copy(), np.zeros(3 * n, np.int8)
    out[under] += k * call
    mask[under] = 1
    return at_full_scale(out, 0.99), mask


def bouts_of_one(total: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Where one animal calls, ends exclusive: all along, at the start, at the end, in the middle, or twice."""
    share = lambda lo, hi: rng.uniform(lo, hi) * total
    kind = int(rng.integers(5))
    if kind == 0:
        return [(0, total)]
    if kind == 1:
        return [(0, round(share(0.25, 0.6)))]
    if kind == 2:
        return [(round(share(0.3, 0.65)), total)]
    if kind == 3:
        width = share(0.2, 0.5)
        return [(max(0, round((total - width) / 2)), min(total, round((total + width) / 2)))]
    return [(0, round(share(0.3, 0.5))), (round(share(0.6, 0.8)), total)]


def bouts_of_many(total: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """A bout for each of two to five animals, half as long again as an equal share, so that neighbours overlap."""
    n = int(rng.integers(2, 6))
    part = total / n
    starts = [max(0.0, k * part - 0.375 * part) for k in range(n)]
    return [(round(a), round(min(total, a + 1.5 * part))) for a in starts]


def starts_in_bout(bout: tuple[int, int], length: int, apart: int, jitter: int, rng: np.random.Generator) -> list[int]:
    """Where calls begin: the first with the bout, each other apart +- jitter behind the end of the one before.

    As many as drawn up to what the mean distance allows, at least one; a single call lies anywhere in the bout. The last
    may begin beyond the bout's end, where only the one before had to end within.
    """
    first, end = bout
    most = int((end - first) // max(apart + jitter / 2, 1))
    n = int(rng.integers(1, most + 1)) if most > 1 else 1
    if n == 1:
        return [first + int(rng.integers(0, max(1, end - first - length)))]
    gaps = apart + rng.integers(-jitter, jitter + 1, n - 1)
    starts = first + np.concatenate([[0], np.cumsum(gaps + length)])
    return [int(s) for k, s in enumerate(starts) if k == 0 or starts[k - 1] + length < end]


def bout_sequence(calls: list[np.ndarray], noise: np.ndarray, fs: float, apart_s: float, jitter_s: float, snr: tuple[float, float], many: bool, rng: np.random.Generator) -> Made:
    """Bouts of one or of several animals over noise. An animal has one level, its calls 1.5 dB around it.

    Calls that would run over the end are left out; where animals overlap their calls add up.
    """
    out, mask = np.asarray(noise, float).copy(), np.zeros(len(noise), np.int8)
    length = max(map(len, calls), default=0)
    if not length:
        return at_full_scale(out, 0.99), mask
    level = rng.uniform(*snr)
    for bout in (bouts_of_many if many else bouts_of_one)(len(noise), rng):
        level = rng.uniform(*snr) if many else level
        for at in starts_in_bout(bout, length, round(apart_s * fs), round(jitter_s * fs), rng):
            call = calls[int(rng.integers(len(calls)))]
            if at < 0 or at + length > len(noise) or not len(call):
                continue
            under = slice(at, at + len(call))
            out[under] += gain(call, noise[under], level + rng.uniform(-1.5, 1.5)) * call
            mask[under] = 1
    return at_full_scale(out, 0.99), mask


def sequences(rows: DataFrame, make: Callable[[list[np.ndarray], np.ndarray, np.random.Generator], Made], seed: int, key: str = "id") -> DataFrame:
    """G1-G4 for tables: rows (key, calls array<array<double>>, noise array<double>) become (key, samples, mask).

    Rows without noise or without a call give null samples and mask.
    """
    arrays.ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, calls, noise in zip(pdf[key], pdf["calls"], pdf["noise"], strict=True):
                c = [np.asarray(x, float) for x in calls if x is not None and len(x)] if calls is not None else []
                out.append((k, *(make(c, np.asarray(noise, float), generator(seed, k)) if c and noise is not None and len(noise) else (None, None))))
            if out:
                yield pd.DataFrame(out, columns=[key, "samples", "mask"])

    return rows.select(key, "calls", "noise").mapInPandas(run, f"{key} {kind}, samples array<double>, mask array<tinyint>")


def multi_call_sequences(rows: DataFrame, fs: int, apart_s: float, snr: tuple[float, float], seed: int, key: str = "id") -> DataFrame:
    """G1"""
    return sequences(rows, lambda calls, noise, rng: dsp.call_sequence(calls, noise, fs, apart_s, snr, int(rng.integers(2**31))), seed, key)


def single_call_sequences(rows: DataFrame, fs: float, band: tuple[float, float], snr: tuple[float, float], seed: int, key: str = "id") -> DataFrame:
    """The row's first call."""
    return sequences(rows, lambda calls, noise, rng: single_call(calls[0], noise, fs, band, snr, rng), seed, key)


def bout_sequences(rows: DataFrame, fs: float, apart_s: float, jitter_s: float, snr: tuple[float, float], many: bool, seed: int, key: str = "id") -> DataFrame:
    """G3"""
    return sequences(rows, lambda calls, noise, rng: bout_sequence(calls, noise, fs, apart_s, jitter_s, snr, many, rng), seed, key)


def frame_pairs(pairs: DataFrame, length: int, hop: int, x: str = "x", t: str = "t") -> DataFrame:
    """A row for each full frame: part, start, x to mean 0 and deviation 1, t as it is. Both are cut alike, without a join."""
    n = F.least(F.size(x), F.size(t))
    f = pairs.select("*", F.posexplode(framing.frame_starts(n, length, hop)).alias("_k", "start"))
    f = f.withColumns({"part": F.col("_k") + 1, x: F.slice(x, F.col("start").cast("int"), length), t: F.slice(t, F.col("start").cast("int"), length)}).drop("_k")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    f = f.withColumn("_m", total(F.col(x)) / length)
    f = f.withColumn("_d", F.sqrt(total(F.transform(x, lambda v: (v - F.col("_m")) * (v - F.col("_m")))) / max(length - 1, 1)))
    return f.withColumn(x, F.transform(x, lambda v: (v - F.col("_m")) / F.greatest(F.col("_d"), F.lit(1e-10)))).drop("_m", "_d")


def export_pairs(pairs: DataFrame, path: str, split: str = "split") -> None:
    """Pairs as Parquet, a folder for each split."""
    pairs.write.mode("overwrite").partitionBy(split).parquet(path)


def zip_lists(pairs: DataFrame, x: str = "x", t: str = "t") -> DataFrame:
    """A row for each place both lists have: place from 1, x, t. Rows where a list is null or empty go."""
    both = F.arrays_zip(F.col(x).alias("x"), F.col(t).alias("t"))
    n = F.least(F.size(x), F.size(t))
    f = pairs.where(n > 0).select(*[c for c in pairs.columns if c not in (x, t)], F.posexplode(F.slice(both, F.lit(1), n)).alias("_k", "_p"))
    return f.select("*", (F.col("_k") + 1).alias("place"), F.col("_p")["x"].alias(x), F.col("_p")["t"].alias(t)).drop("_k", "_p")


def mean_clip_duration(clips: DataFrame, samples: str, fs: str, valid: str, order: str, first: int = 10, default: float = 0.1) -> DataFrame:
    """The mean seconds of the first clips, where those that can't be read count default; default if there are none."""
    s = F.when(F.coalesce(F.col(valid), F.lit(False)), F.col(samples) / F.col(fs)).otherwise(F.lit(default))
    few = clips.orderBy(order).limit(first).select(s.alias("_s"))
    return few.agg(F.coalesce(F.avg(F.when(F.col("_s") > 0, F.col("_s"))), F.lit(default)).alias("seconds"))


def calls_per_sequence(duration: Column, mean_call: Column, apart: Column, share: float = 0.45) -> Column:
    """How many calls, apart from each other, fill share of a sequence."""
    return F.floor((duration * share + apart) / (mean_call + apart)).cast("long")


def hundreds(n: Column) -> Column:
    return (F.ceil(n / 100) * 100).cast("long")


def copies_per_call(calls: Column, sequences: Column, clean: Column) -> Column:
    """Varied copies of each clean call that the sequences need, in hundreds."""
    return hundreds(F.ceil(calls * sequences / clean))


def clean_samples_needed(sequences: Column, duration: Column, apart: Column, jitter: Column) -> Column:
    """Calls that sequences of bouts use, 60 % of what fits into each, and a fifth more, in hundreds."""
    each = F.floor(duration / (apart + jitter)) * 0.6
    total = F.ceil(sequences / 2) * each + F.floor(sequences / 2) * (each / 3.5 * 3.5)
    return hundreds(F.ceil(F.round(total * 1.2, 6)))
