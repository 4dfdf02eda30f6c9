"""More registered queries: row filters, sample probabilities, dynamic ranges, training health, names, sources' arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import micros
from ..operators import intervals, matching, metrics, sampling
from ..sources import recordings
from .queries import FRAMES, MERGED, _SCORED, frames, merged, query, r9, scored, table


@query(FRAMES + " SELECT file, frame, (frame - 1) * 12 + 1 AS first_sample, least(frame * 12, 500) AS last_sample, round(least(greatest(prob * 1.2, 0), 1), 9) AS prob FROM frames WHERE (frame - 1) * 12 + 1 <= 500")
def w8_sample_spans(spark, sf):
    f = frames(spark, sf).select("file", "frame", (F.col("prob") * 1.2).alias("prob"))
    return intervals.sample_spans(f, 12, 500).select("file", "frame", "first_sample", "last_sample", r9("prob").alias("prob"))


@query(MERGED + """, b AS (SELECT *, least(greatest(round((first - 1) * 12 + 1 - 106 - 6), 1), 500)::BIGINT AS start_sample, least(greatest(round((last - 1) * 12 + 1 - 106 + 6), 1), 500)::BIGINT AS end_sample FROM merged)
SELECT b.file, b.first, b.last, round(coalesce(sum((least(end_sample, frame * 12) - greatest(start_sample, (frame - 1) * 12 + 1) + 1) * least(greatest(prob, 0), 1)), 0) / (end_sample - start_sample + 1), 8) AS confidence
FROM b LEFT JOIN frames f ON f.file = b.file AND frame * 12 >= start_sample AND (frame - 1) * 12 + 1 <= end_sample GROUP BY b.file, b.first, b.last, start_sample, end_sample""")
def w9_sample_confidence(spark, sf):
    r = intervals.frame_to_samples(merged(spark, sf), 12, 212, 500)
    return intervals.sample_confidence(r, frames(spark, sf).select("file", "frame", "prob"), 12, 500).select("file", "first", "last", F.round("confidence", 8).alias("confidence"))


@query(FRAMES + """, l AS (SELECT file, frame, log10(greatest(value, 1e-10)) AS l FROM frames), z AS (SELECT file, frame, (l - avg(l) OVER (PARTITION BY file)) / (2 * stddev_samp(l) OVER (PARTITION BY file)) + 0.5 AS z FROM l),
g AS (SELECT *, sum(CASE WHEN z < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame) AS g FROM z), a AS (SELECT *, z >= 0 AND max(CASE WHEN z >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY file, g ORDER BY frame) = 1 AS on_ FROM g),
i AS (SELECT file, frame, frame - row_number() OVER (PARTITION BY file ORDER BY frame) AS k FROM a WHERE on_), r AS (SELECT file, min(frame) AS first, max(frame) AS last FROM i GROUP BY file, k),
n AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY file ORDER BY first) > 2 THEN 1 ELSE 0 END AS new FROM r), q AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY first) AS g FROM n), m AS (SELECT file, min(first) AS first, max(last) AS last FROM q GROUP BY file, g) SELECT file, first, last FROM m WHERE last - first + 1 > 2""")
def w10_energy_regions(spark, sf):
    return intervals.energy_regions(frames(spark, sf).select("file", "frame", F.col("value").alias("energy")), 2, 2).select("file", "first", "last")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_id % 5 = 0 THEN 'no start time' WHEN value < 20 THEN 'invalid audio' END AS fail_comment FROM events")
def f2_fail_comment(spark, sf):
    name = F.when(F.col("event_id") % 5 == 0, "noise.wav").otherwise(F.date_format("ts", "yyyyMMdd_HHmmss'.wav'"))
    return table(spark, sf, "events").select("event_id", S.fail_comment(F.col("event_type") != "error", S.time_from_name(S.file_stem(name)), F.col("value") >= 20).alias("fail_comment"))


@query("SELECT event_type, count(*) AS n, count_if(event_id % 7 = 0)::BIGINT AS removed, min(epoch_us(date_trunc('millisecond', ts))) FILTER (event_id % 7 <> 0) AS first_us FROM events GROUP BY event_type")
def f5_parsed_times(spark, sf):
    stamp = F.when(F.col("event_id") % 7 == 0, "20XX/1/1 00:00:00.000").otherwise(F.date_format("ts", "yyyy/M/d HH:mm:ss.SSS"))
    t = table(spark, sf, "events").select("event_type", S.time_from_stamp(stamp).alias("t"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("removed"), F.min(micros("t")).alias("first_us"))


@query("SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f6_valid_only(spark, sf):
    ok = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("valid")).where("valid")
    return table(spark, sf, "documents").where("n_chars > 500").select("doc_id").join(ok, "doc_id", "left_semi")


@query("WITH n AS (SELECT user_id, count(*) AS frames, sum(event_id % 3 + 10) AS samples FROM events GROUP BY user_id), e AS (SELECT *, ceil((samples + 212 - 212 + 12) / 12.0)::BIGINT AS expected FROM n) SELECT user_id, frames, expected, abs(expected - frames) <= 1 AS consistent FROM e")
def f13_frame_consistency(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.col("event_id") % 3 + 10).alias("samples"))
    n = n.withColumn("expected", S.expected_frames(F.col("samples"), F.lit(250), 250, 212, 12))
    return n.select("user_id", "frames", "expected", (F.abs(F.col("expected") - F.col("frames")) <= 1).alias("consistent"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'FP' ELSE 'FN' END AS kind, count_if(toxic = 1 OR quality IS NULL)::BIGINT AS undecided, count_if(toxic = 1 OR quality IS NULL) = 0 AS complete FROM labels GROUP BY ALL")
def f14_unadjudicated(spark, sf):
    d = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 2 == 0, "FP").otherwise("FN").alias("kind"), F.when(F.col("toxic") == 1, "").otherwise(F.col("quality").cast("string")).alias("decision"))
    empty = F.count_if(F.col("decision").isNull() | (F.col("decision") == ""))
    return d.groupBy("kind").agg(empty.alias("undecided"), (empty == 0).alias("complete"))


@query("WITH a AS (SELECT user_id, event_id AS d_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS r_id, ts AS r_ts FROM events WHERE event_type <> 'click'), r AS (SELECT d_id, r_id, row_number() OVER (PARTITION BY d_id ORDER BY r_id) AS k FROM a JOIN b ON a.user_id = b.user_id AND abs(epoch_us(ts) - epoch_us(r_ts)) < 7200000000) SELECT d_id, r_id FROM r WHERE k = 1")
def j6_first_within(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("d_id"), "ts")
    right = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts"))
    return matching.first_within(left, right, "user_id", "ts", "r_ts", 7_200_000_000, "r_id").select("d_id", "r_id")


@query("SELECT m::INT AS model, n_name AS path FROM nation, (SELECT unnest(range(4)) AS m)")
def j14_models_by_paths(spark, sf):
    return matching.cross(spark.range(4).select(F.col("id").cast("int").alias("model")), table(spark, sf, "nation").select(F.col("n_name").alias("path")))


_CELLS = FRAMES + ", cells AS (SELECT file, (frame - 1) // 4 AS t, (frame - 1) % 4 AS band, 20 * log10(value + 1) AS db FROM frames)"


def _pct(values: str, level: float) -> str:
    r = f"least(greatest({level} * len({values}) / 100.0 + 0.5, 1), len({values}))"
    return f"({values}[floor({r})::INT] + ({r} - floor({r})) * (coalesce({values}[floor({r})::INT + 1], {values}[floor({r})::INT]) - {values}[floor({r})::INT]))"


_FILES = _CELLS + f""", l AS (SELECT file, list_sort(list(db)) AS v, max(db) AS most, min(db) AS least, avg(db) AS mean, stddev_samp(db) AS std, median(db) AS median, count(*) AS n FROM cells GROUP BY file),
d AS (SELECT c.file, median(abs(db - median)) AS mad FROM cells c JOIN l ON l.file = c.file GROUP BY c.file), o AS (SELECT c.file, count_if(abs(db - median) > 5 * mad)::BIGINT AS outliers FROM cells c JOIN l ON l.file = c.file JOIN d ON d.file = c.file GROUP BY c.file),
tt AS (SELECT file, t, max(db) - min(db) AS r FROM cells GROUP BY file, t), tr AS (SELECT file, max(r) AS temporal_max, avg(r) AS temporal_mean, stddev_samp(r) AS temporal_std, median(r) AS temporal_median FROM tt GROUP BY file),
bb AS (SELECT file, band, max(db) - min(db) AS r FROM cells GROUP BY file, band), br AS (SELECT file, max(r) AS band_max, avg(r) AS band_mean, stddev_samp(r) AS band_std, median(r) AS band_median FROM bb GROUP BY file),
files AS (SELECT l.file, most, least, mean, std, median, n, most - least AS range, {_pct("v", 99.9)} - {_pct("v", 0.1)} AS robust_range, mad, outliers, 1.4826 * mad AS robust_std, 100.0 * outliers / n AS outlier_pct,
  temporal_max, temporal_mean, temporal_std, temporal_median, band_max, band_mean, band_std, band_median FROM l JOIN d ON d.file = l.file JOIN o ON o.file = l.file JOIN tr ON tr.file = l.file JOIN br ON br.file = l.file)"""
_RANGES = ("range", "robust_range", "mean", "std", "median", "mad", "robust_std", "outlier_pct", "temporal_max", "temporal_mean", "temporal_std", "temporal_median", "band_max", "band_mean", "band_std", "band_median")


def cells(spark, sf):
    return frames(spark, sf).select("file", F.floor((F.col("frame") - 1) / 4).alias("t"), ((F.col("frame") - 1) % 4).alias("band"), (20 * F.log10(F.col("value") + 1)).alias("db"))


@query(_FILES + " SELECT file, n, outliers, " + ", ".join(f"round({c}, 7) AS {c}" for c in _RANGES) + " FROM files")
def a18_file_dynamic_range(spark, sf):
    x = metrics.file_dynamic_range(cells(spark, sf), "file", "t", "band", "db")
    return x.select("file", "n", "outliers", *[F.round(c, 7).alias(c) for c in _RANGES])


_SPREAD = ("range_mean", "range_std", "range_median", "robust_mean", "robust_std", "most", "least", "level_mean", "level_median", "std_consistency", "mad_consistency", "level_variation", "std_inflation")


@query(_FILES + f""", a AS (SELECT list_sort(list(db)) AS v FROM cells), g AS (SELECT count(*) AS files, avg(range) AS range_mean, stddev_samp(range) AS range_std, median(range) AS range_median, avg(robust_range) AS robust_mean, stddev_samp(robust_range) AS robust_std,
  max(most) AS most, min(least) AS least, avg(mean) AS level_mean, median(median) AS level_median, stddev_samp(std) AS std_consistency, stddev_samp(mad) AS mad_consistency, stddev_samp(mean) / abs(avg(mean)) AS level_variation, avg(std / (mad * 1.4826)) AS std_inflation, list_sort(list(range)) AS r FROM files)
SELECT files, {", ".join(f"round({c}, 6) AS {c}" for c in _SPREAD)}, ceil(robust_mean + 2 * robust_std)::BIGINT AS saturation_conservative, ceil({_pct("v", 95)} - {_pct("v", 5)})::BIGINT AS saturation_95, ceil({_pct("v", 99)} - {_pct("v", 1)})::BIGINT AS saturation_99, ceil({_pct("r", 75)})::BIGINT AS saturation_data,
  CASE WHEN std_inflation > 1.5 THEN 'robust' ELSE 'standard' END AS standardization, CASE WHEN range_std / range_mean > 0.3 THEN 'file-level-normalization' ELSE 'global-normalization' END AS strategy FROM g, a""")
def a19_dataset_dynamic_range(spark, sf):
    c = cells(spark, sf)
    x = metrics.dataset_dynamic_range(metrics.file_dynamic_range(c, "file", "t", "band", "db"), c, "db")
    whole = [F.col(k).cast("long").alias(k) for k in ("saturation_conservative", "saturation_95", "saturation_99", "saturation_data")]
    return x.select("files", *[F.round(k, 6).alias(k) for k in _SPREAD], *whole, "standardization", "strategy")


_OVER = FRAMES + """, x AS (SELECT file, frame AS k, prob AS train, value / 100.0 AS val, value / 100.0 - prob AS gap, count(*) OVER (PARTITION BY file) AS n FROM frames),
g AS (SELECT file, max(n) AS n, arg_max(gap, k) AS final_gap, arg_min(gap, k) AS first_gap, max(gap) AS max_gap, avg(gap) AS mean_gap, regr_slope(CASE WHEN k >= ceil(n / 2.0) THEN train END, CASE WHEN k >= ceil(n / 2.0) THEN k::DOUBLE END) AS train_slope, regr_slope(CASE WHEN k >= ceil(n / 2.0) THEN val END, CASE WHEN k >= ceil(n / 2.0) THEN k::DOUBLE END) AS val_slope FROM x GROUP BY file),
o AS (SELECT *, n >= 5 AND n - ceil(n / 2.0) >= 3 AND val_slope - train_slope > 0.001 AND abs(final_gap) > 0.001 AND (val_slope > 0 OR train_slope < 0) AS over_ FROM g)"""


@query(_OVER + """ SELECT file, round(final_gap, 9) AS final_gap, round(max_gap, 9) AS max_gap, round(mean_gap, 9) AS mean_gap, round(final_gap - first_gap, 9) AS gap_trend, round(train_slope, 8) AS train_slope, round(val_slope, 8) AS val_slope, over_ AS overfitting,
CASE WHEN NOT over_ THEN 'None' WHEN abs(final_gap) > 0.003 THEN 'Severe' WHEN abs(final_gap) > 0.002 THEN 'Moderate' ELSE 'Mild' END AS severity FROM o WHERE n >= 8""")
def a23_overfitting(spark, sf):
    f = frames(spark, sf).select("file", "frame", "prob", (F.col("value") / 100.0).alias("val"), F.count("*").over(Window.partitionBy("file")).alias("n")).where("n >= 8")
    x = metrics.overfitting(f, "prob", "val", "frame", ["file"], 0.001)
    return x.select("file", *[r9(c).alias(c) for c in ("final_gap", "max_gap", "mean_gap", "gap_trend")], *[F.round(c, 8).alias(c) for c in ("train_slope", "val_slope")], "overfitting", "severity")


@query("""WITH n AS (SELECT CASE event_type WHEN 'click' THEN 'ValidationAccuracy' WHEN 'view' THEN 'F1_score' ELSE event_type END AS metric, value, event_id FROM events), g AS (SELECT metric, arg_min(value, event_id) AS initial, arg_max(value, event_id) AS final, avg(value) AS mean, metric IN ('ValidationAccuracy', 'F1_score') AS should_increase FROM n GROUP BY metric)
SELECT metric, should_increase, round(mean, 6) AS mean, round(CASE WHEN should_increase THEN final - initial ELSE initial - final END, 9) AS improvement, CASE WHEN should_increase THEN final - initial ELSE initial - final END > 0 AS improving FROM g""")
def a27_metric_direction(spark, sf):
    name = F.when(F.col("event_type") == "click", "ValidationAccuracy").when(F.col("event_type") == "view", "F1_score").otherwise(F.col("event_type"))
    x = metrics.metric_direction(table(spark, sf, "events").withColumn("metric", name), "metric", "value", "event_id")
    return x.select("metric", "should_increase", F.round("mean", 6).alias("mean"), r9("improvement").alias("improvement"), "improving")


def _issue_sql() -> str:
    text = {k: (a.replace("'", "''"), b.replace("'", "''")) for k, a, b in metrics.ISSUES}
    when = {"increasing": "inc", "oscillating": "NOT inc AND osc", "not_converged": "NOT inc AND NOT osc AND NOT conv", "vanishing": "van", "exploding": "expl", "unstable": "inc AND van", "rate_high": "osc", "premature": "pre", "poor": "NOT pre AND NOT conv"}
    rows = [(f"CASE WHEN {when[k]} THEN '{a}' END", f"CASE WHEN {when[k]} THEN '{b}' END") for k, (a, b) in text.items()]
    rows.insert(3, ("CASE WHEN sev <> 'None' THEN sev || ' overfitting detected' END", f"CASE WHEN sev = 'Severe' THEN '{metrics.OVERFIT_ADVICE[0]}' WHEN sev <> 'None' THEN '{metrics.OVERFIT_ADVICE[1]}' END"))
    both = [f"array_to_string(list_filter([{', '.join(r[i] for r in rows)}], lambda x: x IS NOT NULL), '; ')" for i in (0, 1)]
    return f"""WITH b AS (SELECT doc_id, doc_id % 2 = 0 AS inc, doc_id % 3 = 0 AS osc, doc_id % 5 < 2 AS conv, doc_id % 7 = 0 AS van, doc_id % 11 = 0 AS expl, doc_id % 13 < 4 AS pre, ['None', 'Mild', 'Moderate', 'Severe'][doc_id % 4 + 1] AS sev FROM documents)
SELECT doc_id, {both[0]} AS issues, {both[1]} AS recommendations FROM b"""


@query(_issue_sql())
def a28_issues(spark, sf):
    k = F.col("doc_id")
    flags = {"increasing": k % 2 == 0, "oscillating": k % 3 == 0, "converged": k % 5 < 2, "vanishing": k % 7 == 0, "exploding": k % 11 == 0, "unstable": (k % 2 == 0) & (k % 7 == 0), "rate_high": k % 3 == 0, "premature": k % 13 < 4, "well_converged": k % 5 < 2}
    severity = F.element_at(F.array(*map(F.lit, ("None", "Mild", "Moderate", "Severe"))), (k % 4 + 1).cast("int"))
    x = metrics.issues(table(spark, sf, "documents").select("doc_id").withColumns(flags | {"severity": severity}))
    return x.select("doc_id", F.array_join("issues", "; ").alias("issues"), F.array_join("recommendations", "; ").alias("recommendations"))


@query("WITH " + _SCORED + ", f AS (SELECT event_type, score, 2.0 * tp / (tp + fp + p) AS f1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC, score) AS k FROM f) SELECT event_type, score, round(f1, 9) AS f1 FROM r WHERE k = 1")
def a29_peak_f1(spark, sf):
    c = metrics.roc(scored(spark, sf), "score", "hit", ["event_type"]).withColumns({"tp": F.col("tpr") * F.col("p"), "fp": F.col("fpr") * F.col("q")})
    # counts again, so that equal values are equal to the last digit
    c = c.withColumn("f1", 2.0 * F.round("tp") / (F.round("tp") + F.round("fp") + F.col("p")))
    return metrics.peak(c, "f1", "score", ["event_type"]).select("event_type", "score", r9("f1").alias("f1"))


@query("SELECT event_type, count_if(value > 5)::BIGINT AS n, round(avg(value * 250 / 250.0) FILTER (value > 5), 6) AS mean_s, min(value * 250 / 250.0) FILTER (value > 5) AS least_s, max(value * 250 / 250.0) FILTER (value > 5) AS most_s FROM events GROUP BY event_type")
def a32_clip_durations(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") * 250).alias("samples"), F.lit(250.0).alias("fs"), (F.col("value") > 5).alias("valid"))
    return metrics.clip_durations(e, "samples", "fs", "valid", ["event_type"]).select("event_type", "n", F.round("mean_s", 6).alias("mean_s"), "least_s", "most_s")


@query("SELECT s_suppkey, regexp_extract(s_name, '#0*([0-9]+)$', 1) AS number, split_part(s_name, '#', 1) AS kind, replace(upper(s_name), '#', '-') AS tag, contains(s_name, '7') AS seven FROM supplier")
def x5_text_parts(spark, sf):
    n = F.col("s_name")
    return table(spark, sf, "supplier").select("s_suppkey", F.regexp_extract(n, "#0*([0-9]+)$", 1).alias("number"), F.split(n, "#")[0].alias("kind"), F.replace(F.upper(n), F.lit("#"), F.lit("-")).alias("tag"), n.contains("7").alias("seven"))


@query("SELECT event_id, least(greatest(floor(value * 1e6 * 0.7 / (4096.0 * 1.8)), 1), 2048)::BIGINT AS batch, round(0.95 + (event_id % 30) * ((0.005 - 0.95) / 29), 9) AS threshold FROM events")
def x19_x24_batch_and_grid(spark, sf):
    grid = F.element_at(S.linspace(0.95, 0.005, 30), (F.col("event_id") % 30 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", S.batch_size(F.col("value") * 1e6, F.lit(4096.0)).alias("batch"), r9(grid).alias("threshold"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN round((event_id % 4) * 100 * 250.0 + 0)::BIGINT + 1 END AS start_sample, CASE WHEN event_id % 4 <> 3 THEN round((event_id % 4) * 100 * 250.0)::BIGINT + 1 + 2500 - 1 END AS end_sample FROM events")
def x27_missed_ranges(spark, sf):
    t = F.date_trunc("second", "ts")
    at = F.timestamp_micros(micros(t) + F.when(F.col("event_id") % 4 == 3, -5_000_000).otherwise(F.col("event_id") % 4 * 100_000_000))
    a, b = S.missed_range(at, F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".wav")), F.lit(250), 10.0)
    return table(spark, sf, "events").select("event_id", a.alias("start_sample"), b.alias("end_sample"))


@query("SELECT doc_id, (n_chars * 100 - 44) / 2.0 / 250 AS seconds FROM documents")
def s4_duration_from_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", recordings.duration_from_size(F.col("n_chars") * 100, 250).alias("seconds"))


@query("SELECT doc_id FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE doc_id = 1) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def s20_unprocessed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    left = recordings.unprocessed(d, table(spark, sf, "labels"), "doc_id")
    return recordings.unprocessed(left, d.where("doc_id = 1"), "lang").select("doc_id")


@query("SELECT arg_max(o_orderkey, o_totalprice) AS path FROM orders")
def t3_newest(spark, sf):
    return recordings.newest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("modificationTime")))


@query("WITH s AS (SELECT source, count(*) AS saved FROM documents GROUP BY source) SELECT source, saved, row_number() OVER (ORDER BY CASE WHEN saved >= 100 THEN 1 ELSE 0 END, md5('1|' || source), source) AS turn FROM s")
def t8_needy_first(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("saved"))
    turn = F.row_number().over(Window.orderBy((F.col("saved") >= 100).cast("int"), sampling.draw("source"), "source"))  # one row a source
    return s.select("source", "saved", turn.cast("long").alias("turn"))
