"""Bins, strata, quotas and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*keys: str, seed: int = 1) -> Column:
    """A repeatable random order from an id."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def equal_width_bins(df: DataFrame, value: str, n: int, to: str) -> DataFrame:
    """N bins of equal width with open ends; a range under 1e-6 is widened by 1 on both sides; null and NaN go to bin n + 1."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    e = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    tiny = F.col("_hi") - F.col("_lo") < 1e-6
    e = e.select(F.when(tiny, F.col("_lo") - 1).otherwise(F.col("_lo")).alias("_lo"), F.when(tiny, F.col("_hi") + 1).otherwise(F.col("_hi")).alias("_hi"))
    k = F.least(F.greatest(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n) + 1, F.lit(1)), F.lit(n))
    return df.crossJoin(F.broadcast(e)).withColumn(to, F.when(v.isNull(), F.lit(n + 1)).otherwise(k).cast("int")).drop("_lo", "_hi")  # one row is sent


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """T4"""
    return df.orderBy(draw(key), key).limit(n)


def split_exact(df: DataFrame, key: str, share: float, by: str) -> DataFrame:
    """T5: adds train, true for round(n * share) rows of each group of by."""
    w = Window.partitionBy(by)
    return df.withColumn("train", F.row_number().over(w.orderBy(draw(key), key)) <= F.round(F.count("*").over(w) * share))


def until(df: DataFrame, key: str, duration: str, target: float, by: str) -> DataFrame:
    """Rows in random order until their durations reach target, within each group of by."""
    w = Window.partitionBy(by).orderBy(draw(key), key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", F.sum(duration).over(w) - F.col(duration)).where(F.col("_s") < target).drop("_s")


def stratified(df: DataFrame, strata: list[str], key: str, duration: str, target: float) -> DataFrame:
    """Of each stratum ceil(target * share / mean duration) rows at most; strata by falling share until target is reached."""
    g = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    mean = df.agg(F.avg(duration).alias("_mean"), F.count("*").alias("_all"))
    g = g.crossJoin(F.broadcast(mean)).withColumn("_quota", F.least(F.col("_n"), F.ceil(target * (F.col("_n") / F.col("_all")) / F.col("_mean"))))
    x = df.join(g, strata).withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(draw(key), key))).where("_r <= _quota")
    done = x.groupBy(*strata, "_n").agg(F.sum(duration).alias("_d"))
    before = F.sum("_d").over(Window.orderBy(F.desc("_n"), *strata).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_d")  # one row a stratum
    keep = done.withColumn("_b", before).where(F.col("_b") < target).select(*strata)
    return x.join(keep, strata, "left_semi").select(*df.columns)


def stable_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))


def needy_first(sites: DataFrame, saved: str, least: int, key: str) -> DataFrame:
    """Sites in the order to visit: those under their minimum first, then by a random order."""
    return sites.orderBy((F.col(saved) >= least).cast("int"), draw(key), key)
