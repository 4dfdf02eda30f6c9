"""Probability series to events: hysteresis, regions, merging, filtering, boundaries, confidence, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import samples_of


def hysteresis(frames: DataFrame, on: float, off: float, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """Adds active. On at value >= on, stays on while value >= off.

    A value below off starts a new stretch; within a stretch, all from the first value >= on is active. Windows only.
    """
    if not off < on:
        raise ValueError("the lower threshold lies below the upper one")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = frames.withColumn("_g", F.sum((F.col(value) < off).cast("int")).over(w))
    s = Window.partitionBy(by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    active = (F.col(value) >= off) & (F.max((F.col(value) >= on).cast("int")).over(s) == 1)
    return x.withColumn("active", F.coalesce(active, F.lit(False))).drop("_g")


def mask_to_regions(frames: DataFrame, by: str = "file", order: str = "frame", mask: str = "active") -> DataFrame:
    """Runs of true as rows (by, first, last), gaps and islands on consecutive order values."""
    w = Window.partitionBy(by).orderBy(order)
    on = frames.where(F.col(mask)).withColumn("_island", F.col(order) - F.row_number().over(w))
    return on.groupBy(by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_island")


def merge_regions(regions: DataFrame, gap: Column | int, by: str = "file", start: str = "first", end: str = "last") -> DataFrame:
    """Regions no further apart than gap become one."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(1))
    x = regions.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def drop_short(regions: DataFrame, least: Column | int, start: str = "first", end: str = "last") -> DataFrame:
    """Keeps regions longer than least."""
    return regions.where(F.col(end) - F.col(start) + 1 > least)


def frame_to_samples(regions: DataFrame, hop: int, window: int, total: Column | int) -> DataFrame:
    """Frame regions to sample boundaries, half a hop wider on both sides, less the padding, clamped to 1..total."""
    at = lambda c: (F.col(c) - 1) * hop + 1 - window // 2
    return regions.withColumns({
        "start_sample": F.least(F.greatest(F.round(at("first") - hop / 2), F.lit(1)), F.lit(total) if isinstance(total, int) else total).cast("long"),
        "end_sample": F.least(F.greatest(F.round(at("last") + hop / 2), F.lit(1)), F.lit(total) if isinstance(total, int) else total).cast("long")})


def sample_to_frame(sample: Column, hop: int, window: int) -> Column:
    """Inverse of the shifted mapping of frame_to_samples."""
    return F.greatest(F.round((sample - 1 + window // 2) / hop) + 1, F.lit(1)).cast("long")


def running(frames: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(_by, _at) with sums up to and before each frame: _s, _c, _nan and _s0, _c0, _nan0, of values, of those not null, of NaN."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(value)
    own = {"_s": F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), "_c": v.isNotNull().cast("long"), "_nan": F.coalesce(F.isnan(v), F.lit(False)).cast("long")}
    return frames.select(F.col(by).alias("_by"), F.col(order).alias("_at"), *[F.sum(c).over(w).alias(n) for n, c in own.items()], *[(F.sum(c).over(w) - c).alias(f"{n}0") for n, c in own.items()])


def confidence(regions: DataFrame, frames: DataFrame, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """W9 by frames: adds the mean value of the frames of each region, whose first and last frame are there.

    Running sums meet the regions at these two frames, by equality: the cost does not grow with the length of a region.
    """
    r = running(frames, by, order, value)
    low = r.select(F.col("_by").alias(by), F.col("_at").alias("first"), "_s0", "_c0", "_nan0")
    high = r.select(F.col("_by").alias(by), F.col("_at").alias("last"), "_s", "_c", "_nan")
    met = regions.join(low, [by, "first"]).join(high, [by, "last"])
    mean = F.when(F.col("_nan") > F.col("_nan0"), F.lit(float("nan"))).when(F.col("_c") > F.col("_c0"), (F.col("_s") - F.col("_s0")) / (F.col("_c") - F.col("_c0")))
    return met.select(*regions.columns, mean.alias("confidence"))


def sample_spans(frames: DataFrame, hop: int, total: Column | int, order: str = "frame", value: str = "prob") -> DataFrame:
    """W8 at one rate: the samples first_sample..last_sample of 1..total that each frame's value holds for, in 0..1. What no frame covers is 0."""
    last = F.least(F.col(order) * hop, F.lit(total) if isinstance(total, int) else total)
    x = frames.withColumns({"first_sample": ((F.col(order) - 1) * hop + 1).cast("long"), "last_sample": last.cast("long"), value: F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))})
    return x.where("first_sample <= last_sample")


def sample_confidence(regions: DataFrame, frames: DataFrame, hop: int, total: Column | int, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """Adds the mean sample probability from start_sample to end_sample, at most total; frames are numbered from 1 without gaps."""
    r = running(frames.withColumn(value, F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))), by, order, value)
    n = frames.groupBy(F.col(by).alias("_n_by")).agg(F.max(order).alias("_n"))
    end = F.least(F.col("end_sample"), F.lit(total) if isinstance(total, int) else total)
    x = regions.join(n, F.col(by) == F.col("_n_by")).drop("_n_by").withColumn("_end", end)
    # the area up to a sample: whole frames before its own, and its share of that
    for name, at in (("_a", F.col("start_sample") - 1), ("_b", F.col("_end"))):
        x = x.withColumn(f"{name}at", at).withColumn(f"{name}f", F.least(F.ceil(F.col(f"{name}at") / hop), F.col("_n")).cast("long"))
        side = r.select(F.col("_by").alias(f"{name}by"), F.col("_at").alias(f"{name}k"), F.col("_s").alias(f"{name}s"), F.col("_s0").alias(f"{name}s0"))
        x = x.join(side, (F.col(by) == F.col(f"{name}by")) & (F.col(f"{name}f") == F.col(f"{name}k")), "left")
        part = F.least(F.col(f"{name}at") - (F.col(f"{name}f") - 1) * hop, F.lit(hop))
        x = x.withColumn(name, F.coalesce(F.col(f"{name}s0") * hop + (F.col(f"{name}s") - F.col(f"{name}s0")) * part, F.lit(0.0)))
    return x.select(*regions.columns, F.when(F.col("_end") >= F.col("start_sample"), (F.col("_b") - F.col("_a")) / (F.col("_end") - F.col("start_sample") + 1)).alias("confidence"))


def detect(frames: DataFrame, on: float = 0.5, off: float = 0.2, gap: int = 1, least: int = 1, by: str = "file") -> DataFrame:
    """The detector's post-processing: W1, W2, W3, W4, W9 in one plan, all partitioned by file."""
    x = hysteresis(frames, on, off, by)
    return confidence(drop_short(merge_regions(mask_to_regions(x, by), gap, by), least), frames, by)


def split_long(regions: DataFrame, most: float, start: str = "first", end: str = "last") -> DataFrame:
    """Regions of 1.5 times most and longer fall into round(length / most) equal pieces; neighbours share their border."""
    length = F.col(end) - F.col(start) + 1
    n = F.when(length / most < 1.5, F.lit(1)).otherwise(F.round(length / most)).cast("int")
    x = regions.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    cut = lambda k: (F.col(start) + F.round((F.col(end) - F.col(start)) * k / F.col("_n"))).cast("long")
    return x.withColumns({"piece_start": cut(F.col("piece") - 1), "piece_end": cut(F.col("piece"))}).drop("_n")


def longest_run(frames: DataFrame, step: float, by: str = "file", order: str = "frame", mask: str = "active") -> DataFrame:
    """W23"""
    r = mask_to_regions(frames, by, order, mask)
    return r.groupBy(by).agg((F.max(F.col("last") - F.col("first") + 1) * step).alias("longest"))


def flatten_detections(results: DataFrame, events: str = "events") -> DataFrame:
    """One row for each event of a nested result, with its slice of the probabilities."""
    x = results.select("*", F.posexplode(events).alias("_k", "_e")).drop(events)
    return x.withColumns({"event": F.col("_k") + 1, "first": F.col("_e.first"), "last": F.col("_e.last"),
                          "probabilities": F.slice("probabilities", F.col("_e.first").cast("int"), (F.col("_e.last") - F.col("_e.first") + 1).cast("int"))}).drop("_k", "_e")


def energy_regions(frames: DataFrame, gap: int, least: int, by: str = "file", order: str = "frame", value: str = "energy") -> DataFrame:
    """Log energies, z-normed to 0.5 +- half a deviation, hysteresis 0.5 / 0, merge, drop."""
    w = Window.partitionBy(by)
    x = frames.withColumn("_l", F.log10(F.greatest(F.col(value), F.lit(1e-10))))
    x = x.withColumn("_z", (F.col("_l") - F.avg("_l").over(w)) / (2 * F.stddev_samp("_l").over(w)) + 0.5)
    return drop_short(merge_regions(mask_to_regions(hysteresis(x, 0.5, 0.0, by, order, "_z"), by, order), gap, by), least)


def zero_where(frames: DataFrame, silent: DataFrame, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """Values of silent frames become 0; silent: rows (by, order)."""
    s = silent.select(by, order).distinct().withColumn("_s", F.lit(True))
    return frames.join(s, [by, order], "left").withColumn(value, F.when(F.col("_s"), F.lit(0.0)).otherwise(F.col(value))).drop("_s")


def seconds_to_samples(x: Column, fs: Column) -> Column:
    return samples_of(x, fs)


def overlap_segments(changes: DataFrame, lengths: DataFrame, by: list[str], place: str, n: str, overlap: int) -> DataFrame:
    """By, first, last of the segments that places from 1 cut a series of n into; all but the last reach overlap into the next.

    The last ends one before n. A series of one sample has no segment; places beyond 1..n are left out, repeated ones count once.
    """
    ends = lengths.select(*by, F.explode(F.array(F.lit(1).cast("long"), F.col(n).cast("long"))).alias("first"), F.col(n).cast("long").alias("_n"))
    cuts = changes.select(*by, F.col(place).cast("long").alias("first")).join(lengths.select(*by, F.col(n).cast("long").alias("_n")), by).where("first between 1 and _n")
    w = Window.partitionBy(*by).orderBy("first")
    x = ends.unionByName(cuts).distinct().withColumn("_next", F.lead("first").over(w)).where("_next is not null")
    last = F.when(F.col("_next") == F.col("_n"), F.col("_n") - 1).otherwise(F.least(F.col("_next") - 1 + overlap, F.col("_n")))
    return x.select(*by, "first", last.alias("last"))
