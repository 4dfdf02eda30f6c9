"""One-to-one matching under a time tolerance, backward as-of joins, spills into the next file."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ship
from ..functions.scalars import micros


def align(a: np.ndarray, b: np.ndarray, tol: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of sorted times that maximise the sum of 2 * tol - |a_i - b_j| over pairs within tol.

    Costs on a line have an optimal matching without crossings, so a banded alignment is exact. Ties go to the match.
    """
    lo, hi = np.searchsorted(b, a - tol).tolist(), np.searchsorted(b, a + tol, side="right").tolist()
    # best[j]: value of the rows so far with the first j of b. Beyond the last band it is constant: those b are too far
    best, top, rows = np.zeros(len(b) + 1, np.int64), 0, []
    for i, (l, h) in enumerate(zip(lo, hi, strict=True)):
        if h > top:
            best[top + 1 : h + 1] = best[top]
            top = h
        old = best[l : h + 1].copy()
        new = old.copy()
        if h > l:
            new[1:] = np.maximum(old[1:], old[:-1] + 2 * tol - np.abs(b[l:h] - a[i]))
            new = np.maximum.accumulate(new)
            best[l : h + 1] = new
        rows.append((l, h, old, new))
    out, j = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        l, h, old, new = rows[i]
        k = min(j, h) - l
        if k <= 0 or new[k] == old[k]:
            continue
        while new[k - 1] == new[k]:
            k -= 1
        j = l + k - 1
        out.append((i, j))
    return out[::-1]


def _slice(t, slice_us: int):
    return F.floor(t / slice_us)


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def match_events(detections: DataFrame, truth: DataFrame, tol_us: int, by: list[str] | None = None, d_id: str = "d_id", t_id: str = "t_id", d_time: str = "d_time", t_time: str = "t_time", slice_us: int | None = None) -> DataFrame:
    """Rows (by, d_id, t_id, gap_us) of the optimal matching.

    All points are sorted within by; a gap over tol separates components, and each component is aligned by itself.
    Components, not keys, are the unit of work of the alignment. The sort before it takes a key's points in one task,
    or, with slice_us, a slice of time of that length; each slice is then told the last point and the last start of a
    component before it, from one row a slice. Give slice_us where by is empty or a key is hot. Rows of a null key or
    time match nothing.
    """
    ship(detections.sparkSession)
    by = by or []
    pts = detections.select(*by, micros(d_time).alias("t"), F.col(d_id).alias("id"), F.lit(0).alias("side")).union(
        truth.select(*by, micros(t_time).alias("t"), F.col(t_id).alias("id"), F.lit(1).alias("side"))).where("t is not null")
    part = by
    if slice_us:
        part = [*by, "_slice"]
        pts = pts.withColumn("_slice", _slice(F.col("t"), slice_us))
        heads = pts.groupBy(*part).agg(F.max("t").alias("_last")).select(*part, F.last("_last").over(_before(by)).alias("t"), F.lit(-1).alias("side"))
        pts = pts.unionByName(heads.where("t is not null"), allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy("t", "side", "id")
    pts = pts.withColumn("_start", F.when(F.coalesce(F.col("t") - F.lag("t").over(w) > tol_us, F.col("side") >= 0), F.col("t"))).withColumn(
        "component", F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if slice_us:
        starts = pts.groupBy(*part).agg(F.max("_start").alias("_started")).select(*part, F.last("_started", True).over(_before(by)).alias("_carried"))
        pts = pts.where("side >= 0").join(starts, part).withColumn("component", F.coalesce("component", "_carried"))
    pts = pts.select(*by, "t", "id", "side", "component")
    keys = [*by, "component"]
    two = pts.groupBy(*keys).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select(*keys)
    pts = pts.join(two, keys, "left_semi")
    head = detections.sparkSession.createDataFrame([], detections.select(*by).schema) if by else None
    types = [f"{f.name} {f.dataType.simpleString()}" for f in head.schema] if head is not None else []

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, t = pdf[pdf["side"] == 0].sort_values(["t", "id"]), pdf[pdf["side"] == 1].sort_values(["t", "id"])
        pairs = align(d["t"].to_numpy(), t["t"].to_numpy(), tol_us)
        i, j = [p[0] for p in pairs], [p[1] for p in pairs]
        out = pd.DataFrame({c: [pdf[c].iloc[0]] * len(pairs) for c in by})
        out["d_id"], out["t_id"] = d["id"].to_numpy()[i], t["id"].to_numpy()[j]
        out["gap_us"] = np.abs(d["t"].to_numpy()[i] - t["t"].to_numpy()[j])
        return out

    return pts.groupBy(*keys).applyInPandas(solve, ", ".join([*types, "d_id long", "t_id long", "gap_us long"]))


def greedy_match(detections: DataFrame, truth: DataFrame, tol_us: int, by: str) -> DataFrame:
    """References in time order take their nearest detection if it lies within tol and no earlier one took it, else none.

    The nearest does not depend on what is taken, so each detection goes to the first reference that it is nearest to.
    """
    bucket = lambda t: F.floor(micros(t) / tol_us)
    t = truth.withColumn("_b", F.explode(F.array(bucket("t_time") - 1, bucket("t_time"), bucket("t_time") + 1)))
    d = detections.withColumn("_b", bucket("d_time"))
    gap = F.abs(micros("t_time") - micros("d_time"))
    near = t.join(d, [by, "_b"]).withColumn("gap_us", gap).where(F.col("gap_us") <= tol_us)
    near = near.groupBy(by, "t_id", "t_time").agg(F.min(F.struct("gap_us", "d_time", "d_id")).alias("m"))
    return near.groupBy(by, F.col("m.d_id").alias("d_id")).agg(F.min(F.struct("t_time", "t_id", "m.gap_us")).alias("f")).select("f.t_id", "d_id", "f.gap_us")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_value: str, to: str = "found", slice_us: int | None = None) -> DataFrame:
    """Adds the right value with the latest time not after the left time; null if there is none. One sort, no range join.

    The sort takes a key's rows in one task, or, with slice_us, a slice of time of that length, to which one row brings
    what the slices before it ended with. Give slice_us where by is empty or a key is hot; times must then be timestamps.
    """
    l = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None).cast(right.schema[right_value].dataType), "_rt": F.lit(None).cast(right.schema[right_time].dataType), "_side": F.lit(1)})
    r = right.select(*by, F.col(right_time).alias("_t"), F.col(right_value).alias("_v"), F.col(right_time).alias("_rt"), F.lit(0).alias("_side"))
    both, part = l.unionByName(r, allowMissingColumns=True), by
    if slice_us:
        part = [*by, "_slice"]
        both = both.withColumn("_slice", _slice(micros("_t"), slice_us))
        ends = both.groupBy(*part).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).getField("_v").alias("_v"), F.max("_rt").alias("_rt"))
        heads = ends.select(*part, *[F.last(c, True).over(_before(by)).alias(c) for c in ("_v", "_rt")], F.lit(-1).alias("_side"))
        both = both.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({to: F.last("_v", True).over(w), f"{to}_time": F.last("_rt", True).over(w)})
    return out.where("_side = 1").drop("_t", "_v", "_rt", "_side", "_slice")


def as_of_within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_value: str, to: str = "found", slice_us: int | None = None) -> DataFrame:
    """As J3, but null where the lag exceeds the mean distance of the right side's times: their range over their number less one."""
    t = micros(right_time)
    step = right.groupBy(*by).agg(F.try_divide(F.max(t) - F.min(t), F.count(t) - 1).alias("_mean"))
    x = as_of(left, right, by, left_time, right_time, right_value, to, slice_us)
    x = x.join(step, by, "left") if by else x.crossJoin(F.broadcast(step))
    near = micros(left_time) - micros(f"{to}_time") <= F.col("_mean")
    return x.withColumns({to: F.when(near, F.col(to)), f"{to}_time": F.when(near, F.col(f"{to}_time"))}).drop("_mean")


def spill(events: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Adds end_file: the successor of the event's file, where the event ends beyond its file and the successor has begun."""
    w = Window.partitionBy(*by).orderBy("file_start")
    f = files.select(*by, "file", "file_start", F.lead("file").over(w).alias("_next"), F.lead("file_start").over(w).alias("_next_start"), "file_end")
    x = events.join(f, [*by, "file"])
    return x.withColumn("end_file", F.when((F.col("event_end") > F.col("file_end")) & (F.col("_next_start") < F.col("event_end")), F.col("_next")).otherwise(F.col("file"))).drop("_next", "_next_start")


def first_within(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tol_us: int, order: str) -> DataFrame:
    """Each left row with the first right row of the same key within tol."""
    met = left.join(right, by).where(F.abs(micros(left_time) - micros(right_time)) < tol_us)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*left.columns).orderBy(order))).where("_n = 1").drop("_n")


def place_apart(lengths: list[int], total: int, apart: int, seed: int, tries: int = 1000) -> list[tuple[int, int]]:
    """Random starts of intervals that keep apart samples between each other; fewer if there is no room."""
    rng, out = np.random.default_rng(seed), []
    for n in lengths:
        for _ in range(tries):
            if total < n:
                break
            s = int(rng.integers(1, total - n + 2))
            if all(s + n - 1 + apart < a or s > b + apart for a, b in out):
                out.append((s, s + n - 1))
                break
    return sorted(out)


def cross(params: DataFrame, rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Every row under every parameter set; parameter sets are few, which is checked."""
    if params.limit(most + 1).count() > most:
        raise ValueError("too many parameter sets to send along")
    return rows.crossJoin(F.broadcast(params))


def mask_union(a: DataFrame, b: DataFrame, keys: list[str], mask: str = "active") -> DataFrame:
    """True where either is."""
    x = a.select(*keys, mask).union(b.select(*keys, mask))
    return x.groupBy(*keys).agg(F.bool_or(mask).alias(mask))


