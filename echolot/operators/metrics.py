"""Detection metrics, curves, calibration, robust statistics, training-log analysis, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint_percentiles(df: DataFrame, value: str, levels: list[float], by: list[str] | None = None) -> DataFrame:
    """A2: sorted x_k sits at 100 (k - 0.5) / n, linear between, clamped at the ends; nulls and NaN are ignored.

    Values are counted first, so ranks come from running counts of distinct values. Without by, the distinct values
    meet in one window; round them first where they are many.
    """
    by = by or []
    c = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    up = F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumns({"_hi": up, "_n": F.sum("_c").over(w)}).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    c = c.withColumn("level", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    k = F.least(F.greatest(F.col("level") * F.col("_n") / 100 + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
    c = c.withColumns({"_k0": F.floor(k), "_f": k - F.floor(k)})
    at = lambda r: F.max(F.when((F.col("_lo") <= r) & (F.col("_hi") >= r), F.col("_v")))
    g = c.groupBy(*by, "level").agg(at(F.col("_k0")).alias("_a"), at(F.col("_k0") + 1).alias("_b"), F.max("_f").alias("_f"))
    return g.select(*by, "level", (F.col("_a") + F.when(F.col("_f") > 0, F.col("_f") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias("percentile"))


def mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, median absolute deviation, values beyond five of these."""
    m = df.groupBy(*by).agg(F.median(value).alias("median"))
    x = df.join(m, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    d = x.groupBy(*by).agg(F.first("median").alias("median"), F.median("_d").alias("mad"))
    return df.join(d, by).groupBy(*by, "median", "mad").agg(F.count_if(F.abs(F.col(value) - F.col("median")) > 5 * F.col("mad")).alias("outliers"))


def shape(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Moments, kurtosis 3 for a normal, variation."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"), F.median(v).alias("median"),
        F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt"), (F.stddev_samp(v) / F.avg(v)).alias("variation"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def precision_recall(counts: DataFrame) -> DataFrame:
    """Counts has tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """A point for each distinct score, from the largest: score, fpr, tpr. Scores are counted before they are ordered."""
    by = by or []
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_q"))
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*by, score, F.sum("_p").over(run).alias("tp"), F.sum("_q").over(run).alias("fp"), F.sum("_p").over(w).alias("p"), F.sum("_q").over(w).alias("q")).select(
        *by, score, ratio(F.col("fp"), F.col("q")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"), "p", "q")


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Trapezoids under the curve; 1 if all are positive, 0 if all negative."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    c = roc(df, score, label, by)
    area = (F.col("fpr") - F.coalesce(F.lag("fpr").over(w), F.lit(0.0))) * (F.col("tpr") + F.coalesce(F.lag("tpr").over(w), F.lit(0.0))) / 2
    return c.withColumn("_a", area).groupBy(*by).agg(F.when(F.max("q") == 0, 1.0).when(F.max("p") == 0, 0.0).otherwise(F.sum("_a")).alias("auc"))


def alarm_curve(df: DataFrame, score: str, label: str, n_truth: int | Column, seconds: float | Column, by: list[str] | None = None) -> DataFrame:
    """A10: recall of the references and false alarms a second at each distinct score, and at one step above the largest and below the smallest."""
    by = by or []
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_q"))
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    s = F.col(score)
    step = F.when(s == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(s))) - 52))
    c = g.withColumns({"_tp": F.sum("_p").over(run), "_fp": F.sum("_q").over(run), "_most": F.max(score).over(w), "_least": F.min(score).over(w)})
    point = lambda at, tp, fp: F.struct(at.alias("s"), tp.alias("tp"), fp.alias("fp"))
    none = F.lit(0).cast("long")
    points = F.array_compact(F.array(point(s, F.col("_tp"), F.col("_fp")), F.when(s == F.col("_most"), point(s + step, none, none)), F.when(s == F.col("_least"), point(s - step, F.col("_tp"), F.col("_fp")))))
    return c.select(*by, F.explode(points).alias("_x")).select(*by, F.col("_x.s").alias(score), (F.col("_x.tp") / n_truth).alias("tpr"), (F.col("_x.fp") / seconds).alias("alarms_per_s"))


def best_temperature(df: DataFrame, score: str, label: str, lo: float = 0.01, hi: float = 10.0, points: int = 129, exact: float = 1e-6) -> float | None:
    """The temperature of least negative log-likelihood; null if one class lacks.

    The likelihood has one optimum, so it lies between the neighbours of the best of some points; these become the next
    bounds. A round is one aggregate over the distinct (score, label) rows, which are counted once and kept.
    """
    q = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    g = df.groupBy(F.round(F.ln(q / (1 - q)), 9).alias("z"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).cache()
    try:
        if g.select("y").distinct().count() < 2:
            return None
        p = 1 / (1 + F.exp(-F.col("z") / F.col("t")))
        loss = -F.sum(F.col("n") * F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p) + 1e-300))
        while hi - lo > exact:
            step = (hi - lo) / (points - 1)
            tried = g.withColumn("t", F.explode(F.array(*[F.lit(lo + k * step) for k in range(points)])))
            best = tried.groupBy("t").agg(loss.alias("loss")).agg(F.min_by("t", F.struct("loss", "t"))).first()[0]
            lo, hi = max(lo, best - step), min(hi, best + step)
        return (lo + hi) / 2
    finally:
        g.unpersist()


def confusion(counts: DataFrame) -> DataFrame:
    """Cells and their percentages of the row."""
    return counts.withColumns({"tp_pct": 100 * ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fn_pct": 100 * ratio(F.col("fn"), F.col("tp") + F.col("fn")),
                               "fp_pct": 100 * ratio(F.col("fp"), F.col("fp") + F.col("tn")), "tn_pct": 100 * ratio(F.col("tn"), F.col("fp") + F.col("tn"))})


#: Decisions that make a false positive a true one, by logic; fixed values.
LOGICS = {
    "inclusive": ("DiscreteCallsPresent", "ChorusPresent", "DiscreteCallsChorusPresent"),
    "discrete_only": ("DiscreteCallsPresent", "DiscreteCallsChorusPresent"),
    "strict_discrete": ("DiscreteCallsPresent",),
    "chorus_aware": ("DiscreteCallsPresent", "DiscreteCallsChorusPresent"),
}


def reclassify(rows: DataFrame, logics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows (kind, decision) under each logic: flips. A false negative flips when nothing is there, whatever the logic."""
    logics = logics or LOGICS
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, d) for k, v in logics.items() for d in v], "logic string, _d string")
    names = spark.createDataFrame([(k,) for k in logics], "logic string")
    x = rows.crossJoin(F.broadcast(names)).join(F.broadcast(table.withColumn("_hit", F.lit(True))), (F.col("decision") == F.col("_d")) & (names["logic"] == table["logic"]), "left").drop(table["logic"])
    return x.withColumn("flips", F.when(F.col("kind") == "FP", F.coalesce("_hit", F.lit(False))).otherwise(F.coalesce(F.col("decision") == "CallChorusAbsent", F.lit(False)))).drop("_d", "_hit")


def adjudicated(flips: DataFrame, n_truth: int, n_tp: int, n_detected: int) -> DataFrame:
    """Metrics after flips; precision is over all detector rows."""
    g = flips.groupBy("logic").agg(F.count_if((F.col("kind") == "FP") & F.col("flips")).alias("fp_to_tp"), F.count_if((F.col("kind") == "FN") & F.col("flips")).alias("fn_to_tn"))
    g = g.withColumns({"truth": F.lit(n_truth) + F.col("fp_to_tp") - F.col("fn_to_tn"), "tp": F.lit(n_tp) + F.col("fp_to_tp")})
    return g.withColumns({"recall": ratio(F.col("tp"), F.col("truth")), "precision": F.col("tp") / n_detected})


def loss_analysis(log: DataFrame, value: str, order: str, by: list[str], recent: int = 10, most_turns: float = 0.5) -> DataFrame:
    """Reduction, recent mean and deviation, share of changes of direction, stability, slope of the later half, and what they say."""
    w = Window.partitionBy(*by).orderBy(order)
    x = log.withColumns({"_d": F.col(value) - F.lag(value).over(w), "_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*by))})
    x = x.withColumn("_turn", (F.signum("_d") != F.signum(F.lag("_d").over(w))).cast("int"))
    late, half = F.col("_k") > F.col("_n") - recent, F.col("_k") >= F.ceil(F.col("_n") / 2)
    g = x.groupBy(*by).agg(
        F.min_by(value, "_k").alias("first"), F.max_by(value, "_k").alias("final"), F.max("_n").alias("n"), F.avg(F.when(late, F.col(value))).alias("recent_mean"), F.stddev_samp(F.when(late, F.col(value))).alias("_sd"),
        F.sum("_turn").alias("_turns"), F.stddev_samp("_d").alias("_d_sd"), F.avg(F.abs("_d")).alias("_d_size"), F.regr_slope(F.when(half, F.col(value)), F.when(half, F.col("_k").cast("double"))).alias("late_slope"))
    long = F.col("n") > 5
    variation = F.when(F.col("recent_mean") > 0, F.col("recent_std") / F.col("recent_mean")).otherwise(0.0)
    return g.withColumn("recent_std", F.coalesce("_sd", F.lit(0.0))).withColumn("variation", variation).select(
        *by, F.when(F.col("first") != 0, 100 * (F.col("first") - F.col("final")) / F.col("first")).otherwise(0.0).alias("reduction_pct"), "recent_mean", "recent_std", "variation", (F.col("variation") < 0.01).alias("converged"),
        F.when(long, F.col("_turns") / (F.col("n") - 1)).otherwise(0.0).alias("turn_ratio"), (long & (F.col("_turns") / (F.col("n") - 1) > most_turns)).alias("oscillating"),
        (long & (F.col("final") > F.col("first"))).alias("increasing"), F.when(long, ratio(F.col("_d_sd"), F.col("_d_size"))).otherwise(0.0).alias("stability"), "late_slope")


def overfitting(log: DataFrame, train: str, val: str, order: str, by: list[str], threshold: float = 0.1) -> DataFrame:
    """The gap of validation over training loss, both slopes over the later half, and whether and how badly it overfits. Under 5 rows: null severity."""
    w = Window.partitionBy(*by)
    x = log.where(F.col(train).isNotNull() & F.col(val).isNotNull()).withColumns({"_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w), "_gap": F.col(val) - F.col(train)})
    half = F.greatest(F.ceil(F.col("_n") / 2), F.lit(1))
    slope = lambda c: F.regr_slope(F.when(F.col("_k") >= half, F.col(c)), F.when(F.col("_k") >= half, F.col("_k").cast("double")))
    g = x.groupBy(*by).agg(F.max("_n").alias("n"), F.max_by("_gap", "_k").alias("final_gap"), F.max("_gap").alias("max_gap"), F.avg("_gap").alias("mean_gap"), F.min_by("_gap", "_k").alias("_first"), slope(train).alias("train_slope"), slope(val).alias("val_slope"))
    enough, trend = F.col("n") >= 5, F.col("n") - F.ceil(F.col("n") / 2) >= 3
    is_over = (F.col("val_slope") - F.col("train_slope") > threshold) & (F.abs("final_gap") > threshold) & ((F.col("val_slope") > 0) | (F.col("train_slope") < 0))
    g = g.withColumn("overfitting", enough & trend & F.coalesce(is_over, F.lit(False)))
    size = F.abs("final_gap")
    severity = F.when(~enough, F.lit(None)).when(~trend, "Unknown").when(~F.col("overfitting"), "None").when(size > 3 * threshold, "Severe").when(size > 2 * threshold, "Moderate").otherwise("Mild")
    own = lambda c, on: F.when(on, c)
    return g.select(*by, *[own(F.col(c), enough).alias(c) for c in ("final_gap", "max_gap", "mean_gap")], own(F.col("final_gap") - F.col("_first"), enough).alias("gap_trend"),
                    *[own(F.col(c), enough & trend).alias(c) for c in ("train_slope", "val_slope")], "overfitting", severity.alias("severity"))


def metric_direction(log: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """For each metric by its name whether it should grow, and by how much it got better from first to last."""
    grows = F.lower(F.col(name)).rlike("accuracy|acc|precision|recall|f1")
    g = log.groupBy(name).agg(F.min_by(value, order).alias("initial"), F.max_by(value, order).alias("final"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    better = F.when(grows, F.col("final") - F.col("initial")).otherwise(F.col("initial") - F.col("final"))
    return g.withColumns({"should_increase": grows, "improvement": better, "improving": better > 0})


#: Issues and what to do about them; fixed values.
ISSUES = (
    ("increasing", "Training loss is increasing", "URGENT: Check data preprocessing, reduce learning rate, or revise model architecture"),
    ("oscillating", "High training loss oscillations", "Reduce learning rate, use learning rate scheduler, or add batch normalization"),
    ("not_converged", "Training loss not converged", "Train longer, adjust learning rate, or check for gradient issues"),
    ("vanishing", "Vanishing gradients", "Use better initialization (Xavier/He), add residual connections, or gradient clipping"),
    ("exploding", "Exploding gradients", "Apply gradient clipping, reduce learning rate, or add batch normalization"),
    ("unstable", "Unstable gradients", "Add batch normalization, reduce learning rate, or use gradient clipping"),
    ("rate_high", "Learning rate may be too high", "Reduce initial learning rate or use learning rate scheduler"),
    ("premature", "Premature convergence", "Use learning rate scheduler, increase model capacity, or train longer"),
    ("poor", "Poor convergence quality", "Train longer, adjust learning rate schedule, or improve optimization settings"),
)
OVERFIT_ADVICE = ("URGENT: Add strong regularization, reduce model complexity, increase dataset size", "Add regularization (dropout, weight decay), early stopping, or data augmentation")


def issues(x: DataFrame) -> DataFrame:
    """Adds issues and recommendations (each once, in order) from increasing, oscillating, converged, severity, vanishing, exploding, unstable, rate_high, premature, well_converged; null where something was not looked at."""
    c, no = F.col, lambda k: F.coalesce(F.col(k), F.lit(False))
    seen = c("converged").isNotNull()
    holds = {
        "increasing": no("increasing"), "oscillating": ~no("increasing") & no("oscillating"), "not_converged": seen & ~no("increasing") & ~no("oscillating") & ~no("converged"),
        "vanishing": no("vanishing"), "exploding": no("exploding"), "unstable": no("unstable"), "rate_high": no("rate_high"), "premature": no("premature"), "poor": c("well_converged").isNotNull() & ~no("premature") & ~no("well_converged")}
    over = c("severity").isin("Severe", "Moderate", "Mild")
    rows = [(F.when(holds[k], F.lit(issue)), F.when(holds[k], F.lit(advice))) for k, issue, advice in ISSUES]
    rows.insert(3, (F.when(over, F.concat(c("severity"), F.lit(" overfitting detected"))), F.when(c("severity") == "Severe", OVERFIT_ADVICE[0]).when(over, OVERFIT_ADVICE[1])))
    return x.withColumns({"issues": F.array_compact(F.array(*[a for a, _ in rows])), "recommendations": F.array_distinct(F.array_compact(F.array(*[b for _, b in rows])))})


def peak(sweep: DataFrame, value: str, param: str, by: list[str]) -> DataFrame:
    """The largest value of a sweep and the first parameter that has it."""
    best = F.max_by(F.struct(param, value), F.struct(F.coalesce(F.nanvl(F.col(value), F.lit(None)), F.lit(float("-inf"))), -F.col(param)))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{param}").alias(param), F.col(f"_b.{value}").alias(value))


def clip_durations(clips: DataFrame, samples: str, fs: str, valid: str, by: list[str]) -> DataFrame:
    """Mean, least and most seconds of the valid clips."""
    d = F.when(F.col(valid), F.col(samples) / F.col(fs))
    return clips.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_s"), F.min(d).alias("least_s"), F.max(d).alias("most_s"))


def file_dynamic_range(cells: DataFrame, by: str, frame: str, band: str, value: str) -> DataFrame:
    """Of a spectrum's cells in dB, ranges over all, over time and over bands, amplitudes, and outliers beyond five MAD."""
    whole = cells.groupBy(by).agg(F.max(value).alias("most"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    whole = whole.withColumn("range", F.col("most") - F.col("least"))
    p = midpoint_percentiles(cells, value, [0.1, 99.9], [by]).groupBy(by).agg((F.max(F.when(F.col("level") > 50, F.col("percentile"))) - F.max(F.when(F.col("level") < 50, F.col("percentile")))).alias("robust_range"))
    robust = mad(cells, value, [by]).withColumn("robust_std", 1.4826 * F.col("mad"))
    out = whole.join(p, by).join(robust, by).withColumn("outlier_pct", 100 * F.col("outliers") / F.col("n"))
    for name, key in (("temporal", frame), ("band", band)):
        each = cells.groupBy(by, key).agg((F.max(value) - F.min(value)).alias("_r")).groupBy(by).agg(
            F.max("_r").alias(f"{name}_max"), F.avg("_r").alias(f"{name}_mean"), F.stddev_samp("_r").alias(f"{name}_std"), F.median("_r").alias(f"{name}_median"))
        out = out.join(each, by)
    return out


def dataset_dynamic_range(files: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """One row over all files of A18 and all cells: spread of the ranges, advice on saturation and standardisation."""
    g = files.agg(
        F.count("*").alias("files"), F.avg("range").alias("range_mean"), F.stddev_samp("range").alias("range_std"), F.median("range").alias("range_median"), F.avg("robust_range").alias("robust_mean"), F.stddev_samp("robust_range").alias("robust_std"),
        F.max("most").alias("most"), F.min("least").alias("least"), F.avg("mean").alias("level_mean"), F.median("median").alias("level_median"), F.stddev_samp("std").alias("std_consistency"), F.stddev_samp("mad").alias("mad_consistency"),
        (F.stddev_samp("mean") / F.abs(F.avg("mean"))).alias("level_variation"), F.avg(F.col("std") / (F.col("mad") * 1.4826)).alias("std_inflation"))
    all_ = midpoint_percentiles(cells, value, [1, 5, 95, 99]).agg(*[F.max(F.when(F.col("level") == k, F.col("percentile"))).alias(f"_p{k}") for k in (1, 5, 95, 99)])
    quarter = midpoint_percentiles(files, "range", [75]).agg(F.max("percentile").alias("_q3"))
    x = g.crossJoin(all_).crossJoin(quarter)  # one row each
    return x.withColumns({
        "saturation_conservative": F.ceil(F.col("robust_mean") + 2 * F.col("robust_std")), "saturation_95": F.ceil(F.col("_p95") - F.col("_p5")), "saturation_99": F.ceil(F.col("_p99") - F.col("_p1")), "saturation_data": F.ceil("_q3"),
        "standardization": F.when(F.col("std_inflation") > 1.5, "robust").otherwise("standard"), "strategy": F.when(F.col("range_std") / F.col("range_mean") > 0.3, "file-level-normalization").otherwise("global-normalization")}).drop("_p1", "_p5", "_p95", "_p99", "_q3")


def rate_changes(log: DataFrame, rate: str, loss: str, order: str, by: list[str]) -> DataFrame:
    """Changes of the learning rate and the share of updates that made the loss larger."""
    w = Window.partitionBy(*by).orderBy(order)
    x = log.withColumns({"_c": (F.col(rate) != F.lag(rate).over(w)).cast("int"), "_w": (F.col(loss) > F.lag(loss).over(w)).cast("int")})
    return x.groupBy(*by).agg(F.sum("_c").alias("changes"), F.avg("_w").alias("bad_ratio"))


def convergence(log: DataFrame, value: str, order: str, by: list[str], flat: float = 0.001) -> DataFrame:
    """Plateau, the first place from which the moving mean improves by less than flat of itself, its percentage, and whether it came early.

    The mean is over min(5, ceil(n / 10)) rows; without such a place, or with 10 rows or fewer, plateau is n.
    """
    w = Window.partitionBy(*by).orderBy(order)
    x = log.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*by))})
    width = F.least(F.lit(5), F.ceil(F.col("_n") / 10))
    mean = lambda k: F.avg(value).over(w.rowsBetween(-(k // 2), (k - 1) // 2))
    x = x.withColumn("_m", F.when(width == 2, mean(2)).when(width == 3, mean(3)).when(width == 4, mean(4)).otherwise(mean(5)))
    x = x.withColumn("_r", (F.col("_m") - F.lead("_m").over(w)) / F.col("_m"))
    at = F.when((F.col("_n") > 10) & (F.col("_r") < flat), F.struct(F.col("_k").cast("long").alias("k"), F.col(value).alias("v")))
    g = x.groupBy(*by).agg(F.min(at).alias("_p"), F.max("_n").alias("_n"))
    return g.select(*by, F.coalesce("_p.k", "_n").alias("plateau"), F.when(F.col("_n") > 10, 100 * F.coalesce("_p.k", "_n") / F.col("_n")).otherwise(100.0).alias("plateau_pct"),
                    F.coalesce((F.col("_n") - F.col("_p.k") > 0.3 * F.col("_n")) & (F.col("_p.v") > 0.01), F.lit(False)).alias("premature"))


def extreme_score(frames: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The weighted sum of seven terms over the envelope in dB; extreme beyond 0.75. Terms of no spread are 0."""
    x = frames.select(*by, (20 * F.log10(F.col(value) + 2.0**-52)).alias("_db"))
    p = midpoint_percentiles(x, "_db", [0.1, 25, 75, 99.9], by).groupBy(*by).agg(
        *[F.max(F.when(F.col("level") == k, F.col("percentile"))).alias(c) for k, c in ((0.1, "_low"), (25.0, "_q1"), (75.0, "_q3"), (99.9, "_high"))])
    s = x.groupBy(*by).agg(F.coalesce(F.var_samp("_db"), F.lit(0.0)).alias("variance"), (F.max("_db") - F.min("_db")).alias("range"), F.skewness("_db").alias("skew"), (F.kurtosis("_db") + 3).alias("kurt"), F.abs(F.mean("_db") - F.median("_db")).alias("shift"))
    s = s.join(p, by)
    inner, outer = F.col("_q3") - F.col("_q1"), F.col("_high") - F.col("_low")
    spread = F.when(inner > 0, outer / inner).when(outer > 0, F.lit(float("inf"))).otherwise(0.0)
    above = lambda c, least, unit: F.greatest(F.nanvl(F.coalesce((c - least) / unit, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    score = (0.35 * F.least(F.col("variance") / 15, F.lit(5.0)) + 0.25 * above(F.sqrt("variance"), 3, 2) + 0.15 * above(F.col("range"), 25, 15) + 0.1 * above(F.col("skew"), 1, 3)
             + 0.1 * above(F.col("kurt"), 4, 5) + 0.03 * above(spread, 4, 3) + 0.02 * F.col("shift") / 2)
    return s.withColumn("score", score).withColumn("extreme", F.col("score") > 0.75).select(*by, "score", "extreme")
