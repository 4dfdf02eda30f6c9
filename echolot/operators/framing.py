"""Overlapping frames, their stitching, moving statistics and recursive smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_starts(bins: Column, length: int, hop: int, keep_rest: bool = False, aligned: bool = True) -> Column:
    """1-based starts of full frames and, with keep_rest, of the remainder.

    aligned places the remainder one hop on; otherwise it starts behind the last full frame.
    """
    n = F.greatest(F.floor((bins - length) / hop) + 1, F.lit(0)).cast("int")
    full = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k * hop + 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    if not keep_rest:
        return full
    rest = F.when(n > 0, n * hop + 1 if aligned else (n - 1) * hop + length + 1).otherwise(F.lit(1)).cast("long")
    covered = F.when(n > 0, (n - 1) * hop + length).otherwise(F.lit(0))
    return F.when(covered < bins, F.concat(full, F.array(rest))).otherwise(full)


def framed(series: DataFrame, length: int, hop: int, values: str = "values", **how) -> DataFrame:
    """A row for each frame: part, start, values."""
    x = series.withColumn("_s", frame_starts(F.size(values), length, hop, **how))
    x = x.select("*", F.posexplode("_s").alias("_k", "start")).drop("_s")
    return x.withColumn("part", F.col("_k") + 1).withColumn(values, F.slice(values, F.col("start").cast("int"), length)).drop("_k")


def overlap_average(parts: DataFrame, hop: int, by: str = "file", part: str = "part", values: str = "values") -> DataFrame:
    """Rows (by, bin, value), the mean of what the frames say of a bin."""
    x = parts.select(by, part, F.posexplode(values).alias("_p", "_v"))
    return x.groupBy(by, ((F.col(part) - 1) * hop + F.col("_p") + 1).cast("long").alias("bin")).agg(F.avg("_v").alias("value"))


def stitch(segments: DataFrame, by: str = "file", start: str = "start_bin", values: str = "values", total: str = "bins") -> DataFrame:
    """Segments on a file's timeline, overlaps averaged, gaps 0."""
    x = segments.select(by, F.col(start).alias("_s"), F.posexplode(values).alias("_p", "_v"))
    seen = x.groupBy(by, (F.col("_s") + F.col("_p")).cast("long").alias("bin")).agg(F.avg("_v").alias("value"))
    spine = segments.groupBy(by).agg(F.max(total).alias("_n")).select(by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("bin"))
    return spine.join(seen, [by, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def moving_mean(x: DataFrame, width: int, by: str = "file", order: str = "frame", value: str = "prob", to: str = "smooth") -> DataFrame:
    """Centred; an even width leans back; the ends shrink."""
    before, after = width // 2, (width - 1) // 2
    return x.withColumn(to, F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-before, after)))


def moving_rms(x: DataFrame, width: int, by: str = "file", order: str = "frame", value: str = "prob", to: str = "rms") -> DataFrame:
    """X15"""
    before, after = width // 2, (width - 1) // 2
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-before, after)
    return x.withColumn(to, F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)))


def differences(x: DataFrame, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """First differences and whether their sign changes."""
    w = Window.partitionBy(by).orderBy(order)
    x = x.withColumn("diff", F.col(value) - F.lag(value).over(w))
    return x.withColumn("turn", F.coalesce(F.signum("diff") * F.signum(F.lag("diff").over(w)) < 0, F.lit(False)))


def recursive_mean(values: Column, b: float) -> Column:
    """m = (1 - b) m + b x along an array, from its first value and anew behind a null."""
    @F.udf("array<double>")
    def run(xs):
        if xs is None:
            return None
        out, m = [], None
        for x in xs:
            m = None if x is None else float(x) if m is None else (1 - b) * m + b * x
            out.append(m)
        return out
    return run(values)


def pcen_coefficient(seconds: float, fs: float, hop: int) -> float:
    """B of the recursive mean for a time constant."""
    t = seconds * fs / hop
    return ((1 + 4 * t * t) ** 0.5 - 1) / (2 * t * t)


def pcen(values: Column, b: float, gain: float = 0.98, bias: float = 2.0, root: float = 0.5, eps: float = 1e-6) -> Column:
    """Energies over their recursive mean, compressed."""
    return F.zip_with(values, recursive_mean(values, b), lambda e, m: F.pow(e / F.pow(eps + m, F.lit(gain)) + bias, F.lit(root)) - F.pow(F.lit(bias), F.lit(root)))


def frame_mode(x: DataFrame, size: int, by: str = "file", order: str = "frame", mask: str = "active") -> DataFrame:
    """Most frequent mask value of each block of size frames; false on ties."""
    block = F.floor((F.col(order) - 1) / size).cast("long").alias("block")
    return x.groupBy(by, block).agg((2 * F.sum(F.col(mask).cast("int")) > F.count("*")).alias(mask))


def window_power(x: DataFrame, size: int, by: str = "file", order: str = "frame", value: str = "prob") -> DataFrame:
    """Mean squares of windows of size with half overlap."""
    hop = size // 2
    k = F.explode(F.sequence(F.greatest(F.ceil((F.col(order) - size) / hop), F.lit(0)), F.floor((F.col(order) - 1) / hop))).alias("win")
    y = x.select(by, (F.col(value) * F.col(value)).alias("_q"), k)
    return y.groupBy(by, "win").agg(F.avg("_q").alias("power"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")
