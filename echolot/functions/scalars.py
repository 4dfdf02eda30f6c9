"""Column functions: validity, clocks, names, levels, calibration, lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1.1754943508222875e-38  # smallest normal 32-bit float
EPS = 2.0**-52
UNIX_DAY = 719529  # day number of 1970-01-01


def micros(t: Column | str) -> Column:
    """Microseconds of the epoch, of times with or without a zone."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def valid_signal(x: Column) -> Column:
    """non-empty, finite, not all zero, not all denormal, not constant."""
    size = F.coalesce(F.size(x), F.lit(0))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    flat = (F.array_max(x) == F.array_min(x)) | F.forall(x, lambda v: F.abs(v) < TINY)
    return (size > 0) & ~F.coalesce(bad, F.lit(False)) & ~F.coalesce(flat, F.lit(False))


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


#: Patterns of a start time in a recording's name, tried in order, and how to read the digits they catch; fixed values.
NAME_PATTERNS = (
    (r"(\d{8}[_-]\d{6})", "yyyyMMddHHmmss"),
    (r"^(\d{8}[_-]\d{6})", "yyyyMMddHHmmss"),
    (r"[A-Za-z0-9]+_(\d{6}-\d{6})", "yyMMddHHmmss"),
    (r"^(\d{4}-\d{2}-\d{2}[_-]\d{2}-\d{2}-\d{2})", "yyyyMMddHHmmss"),
    (r"^(\d{4}-\d{2}-\d{2}[_-]\d{2}:\d{2}:\d{2})", "yyyyMMddHHmmss"),
    (r"^(\d{8}[_-]\d{2}:\d{2}:\d{2})", "yyyyMMddHHmmss"),
    (r"^\d+_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", "yyyyMMddHHmmss"),
)


def time_from_name(name: Column) -> Column:
    """The first pattern whose catch is a time; null if none is."""
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.regexp_extract(name, p, 1), "[^0-9]", ""), F.lit(f)) for p, f in NAME_PATTERNS])


def time_from_stamp(stamp: Column) -> Column:
    """yyyy/M/d HH:mm:ss.SSS, else null."""
    return F.try_to_timestamp(stamp, F.lit("yyyy/M/d HH:mm:ss.SSS"))


def day_number(ts: Column) -> Column:
    """Days since year 0 with a fraction."""
    return micros(ts) / 86_400_000_000.0 + UNIX_DAY


def hour_of_day(day: Column) -> Column:
    return F.floor((day - F.floor(day)) * 24).cast("int")


def file_stem(path: Column) -> Column:
    """The name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def logit(p: Column, clip: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def scaled_probability(p: Column, temperature: float) -> Column:
    """sigmoid(logit(p) / temperature)."""
    return 1 / (1 + F.exp(-logit(p) / temperature))


def amplitude_db(x: Column) -> Column:
    """X8"""
    return 20 * F.log10(F.abs(x) + EPS)


def power_db(x: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def pcen_delta(frequency: Column) -> Column:
    """X16"""
    return 2 + 5 * F.exp(-0.003 * frequency) + 5 * F.exp(-0.0001 * frequency)


def even_length(seconds: Column, fs: Column) -> Column:
    """2 * round(seconds * fs / 2)."""
    return (2 * F.round(seconds * fs / 2)).cast("long")


def frame_count(samples: Column, window: Column, hop: Column, padded: Column) -> Column:
    """Frames of a signal padded on both sides."""
    return (F.floor((samples + 2 * padded - window) / hop) + 1).cast("long")


def batch_size(free_bytes: Column, bytes_per_frame: Column, safety: float = 0.7, overhead: float = 1.8, most: int = 2048) -> Column:
    """X19"""
    return F.greatest(F.least(F.floor(free_bytes * safety / (bytes_per_frame * overhead)), F.lit(most)), F.lit(1)).cast("long")


def samples_of(seconds: Column, fs: Column) -> Column:
    """At least one sample."""
    return F.greatest(F.floor(seconds * fs), F.lit(1)).cast("long")


def drifted_frequency(f0: Column, rate: Column, base_year: Column, year: Column) -> Column:
    """X21"""
    return f0 - rate * (year - base_year)


def snr_gain(signal_power: Column, noise_power: Column, snr_db: Column) -> Column:
    """The factor that lifts a signal to snr_db over the noise."""
    return F.sqrt(noise_power * F.pow(F.lit(10.0), snr_db / 10) / signal_power)


def linspace(lo: float, hi: float, n: int) -> Column:
    """X24"""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: lo + k * ((hi - lo) / max(n - 1, 1)))


def event_time(start: Column, position: Column, samples: Column, fs: Column) -> Column:
    """Start + linspace(0, N / fs, N)[i] in microseconds; the step is (N / fs) / (N - 1)."""
    step = samples / fs / F.greatest(samples - 1, F.lit(1))
    return F.timestamp_micros(micros(start) + F.round((position - 1) * step * 1e6).cast("long"))


def context_window(start: Column, end: Column, least: Column, pad: Column, total: Column) -> tuple[Column, Column]:
    """The event with pad on both sides, at least least long, clipped to 1..total."""
    more = F.greatest(pad, F.ceil((least - (end - start)) / 2))
    return F.greatest(start - more, F.lit(1)).cast("long"), F.least(end + more, total).cast("long")


def clip_pages(duration: Column, page: float) -> Column:
    """X29"""
    return F.ceil(duration / page).cast("long")


def golden(lo: float = 0.01, hi: float = 10.0) -> float:
    return (math.sqrt(5) - 1) / 2 * (hi - lo)


def missed_range(detected: Column, name: Column, fs: Column, longest_s: float) -> tuple[Column, Column]:
    """First and last sample of a missed event, from its time and the start in its file's name; null without one or if it lies before."""
    lag = (micros(detected) - micros(time_from_name(file_stem(name)))) / 1e6
    start = F.when(lag >= 0, F.round(lag * fs) + 1).cast("long")
    return start, (start + F.round(F.lit(longest_s) * fs) - 1).cast("long")


def expected_frames(samples: Column, fs: Column, target: float, window: int, hop: int) -> Column:
    """how many frames a recording's probabilities should have, at rates whose ratio is that of small integers."""
    n = F.when(fs == target, samples).otherwise(F.ceil(samples * target / fs))
    return F.ceil((n + 2 * math.ceil(window / 2) - window + hop) / hop).cast("long")


def fail_comment(readable: Column, start: Column, valid: Column) -> Column:
    """why a recording is passed over, else null."""
    return F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(start.isNull(), "no start time").when(~F.coalesce(valid, F.lit(False)), "invalid audio")
