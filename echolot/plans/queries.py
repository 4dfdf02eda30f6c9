"""The registered queries over the driver's tables, each with the SQL that checks it.

Bindings: frames are events in time order within a user, prob = value / (value + 50); detections are clicks,
references are views; recordings are users; samples of a series are arrays of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import micros
from ..operators import framing, intervals, matching, metrics, sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FRAMES = "frames AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value / (value + 50.0) AS prob, value, ts, event_id, event_type FROM events)"
MASK = FRAMES + """, stretch AS (SELECT *, sum(CASE WHEN prob < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame) AS g FROM frames),
mask AS (SELECT *, prob >= 0.2 AND max(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY file, g ORDER BY frame) = 1 AS active FROM stretch)"""
REGIONS = MASK + """, islands AS (SELECT file, frame, frame - row_number() OVER (PARTITION BY file ORDER BY frame) AS k FROM mask WHERE active),
regions AS (SELECT file, min(frame) AS first, max(frame) AS last FROM islands GROUP BY file, k)"""
MERGED = REGIONS + """, gaps AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY file ORDER BY first) > 2 THEN 1 ELSE 0 END AS new FROM regions),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY first) AS g FROM gaps),
merged AS (SELECT file, min(first) AS first, max(last) AS last FROM grouped GROUP BY file, g)"""
LISTS = FRAMES + ", series AS (SELECT file, list(prob ORDER BY frame) AS p FROM frames GROUP BY file)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("file"), n.alias("frame"), (F.col("value") / (F.col("value") + 50.0)).alias("prob"), "value", "ts", "event_id", "event_type")


def masked(spark, sf):
    return intervals.hysteresis(frames(spark, sf), 0.5, 0.2)


def regions(spark, sf):
    return intervals.mask_to_regions(masked(spark, sf))


def merged(spark, sf):
    return intervals.merge_regions(regions(spark, sf), 2)


def series(spark, sf):
    """Each file's probabilities in order."""
    g = frames(spark, sf).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("frame", "prob"))).alias("p"))
    return g.select("file", F.transform("p", lambda x: x["prob"]).alias("values"))


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


@query(MASK + " SELECT file, frame, active FROM mask")
def w1_hysteresis(spark, sf):
    return masked(spark, sf).select("file", "frame", "active")


@query(REGIONS + " SELECT file, first, last FROM regions")
def w2_mask_to_regions(spark, sf):
    return regions(spark, sf).select("file", "first", "last")


@query(MERGED + " SELECT file, first, last FROM merged")
def w3_merge(spark, sf):
    return merged(spark, sf).select("file", "first", "last")


@query(MERGED + " SELECT file, first, last FROM merged WHERE last - first + 1 > 3")
def w4_drop_short(spark, sf):
    return intervals.drop_short(merged(spark, sf), 3).select("file", "first", "last")


@query(MERGED + """ SELECT file, first, last, least(greatest(round((first - 1) * 12 + 1 - 106 - 6), 1), 5000)::BIGINT AS start_sample, least(greatest(round((last - 1) * 12 + 1 - 106 + 6), 1), 5000)::BIGINT AS end_sample,
greatest(round((least(greatest(round((first - 1) * 12 + 1 - 106 - 6), 1), 5000) - 1 + 106) / 12.0) + 1, 1)::BIGINT AS frame_again FROM merged""")
def w5_w6_boundaries(spark, sf):
    x = intervals.frame_to_samples(merged(spark, sf), 12, 212, 5000)
    return x.select("file", "first", "last", "start_sample", "end_sample", intervals.sample_to_frame(F.col("start_sample"), 12, 212).alias("frame_again"))


@query("SELECT event_id, greatest(floor(value * 0.01 * 250), 1)::BIGINT AS samples FROM events")
def w7_seconds_to_samples(spark, sf):
    return table(spark, sf, "events").select("event_id", S.samples_of(F.col("value") * 0.01, F.lit(250)).alias("samples"))


@query(MERGED + " SELECT m.file, m.first, m.last, round(avg(f.prob), 9) AS confidence FROM merged m JOIN frames f ON f.file = m.file AND f.frame BETWEEN m.first AND m.last WHERE m.last - m.first + 1 > 1 GROUP BY ALL")
def m0_detect(spark, sf):
    x = intervals.detect(frames(spark, sf).select("file", "frame", "prob"), 0.5, 0.2, 2, 1)
    return x.select("file", "first", "last", r9("confidence").alias("confidence"))


@query(MERGED + """, n AS (SELECT *, CASE WHEN (last - first + 1) / 4.0 < 1.5 THEN 1 ELSE round((last - first + 1) / 4.0)::INT END AS k FROM merged), e AS (SELECT *, unnest(range(1, k + 1))::INT AS piece FROM n)
SELECT file, first, last, piece, (first + round((last - first) * (piece - 1)::DOUBLE / k))::BIGINT AS piece_start, (first + round((last - first) * piece::DOUBLE / k))::BIGINT AS piece_end FROM e""")
def w11_split_long(spark, sf):
    return intervals.split_long(merged(spark, sf), 4.0).select("file", "first", "last", "piece", "piece_start", "piece_end")


@query(MERGED + " SELECT m.file, m.first, m.last, round(sum(f.prob), 9) AS total FROM merged m JOIN frames f ON f.file = m.file AND f.frame BETWEEN m.first AND m.last WHERE m.last - m.first + 1 > 1 GROUP BY ALL")
def w14_flatten(spark, sf):
    found = intervals.detect(frames(spark, sf).select("file", "frame", "prob"), 0.5, 0.2, 2, 1)
    ev = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("events"))
    x = intervals.flatten_detections(series(spark, sf).withColumnRenamed("values", "probabilities").join(ev, "file"))
    return x.select("file", "first", "last", r9(F.aggregate("probabilities", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(LISTS + """, n AS (SELECT file, p, greatest(floor((len(p) - 10) / 5.0) + 1, 0)::INT AS k FROM series), e AS (SELECT file, p, unnest(range(k)) AS j FROM n)
SELECT file, (j + 1)::INT AS part, (j * 5 + 1)::BIGINT AS start, round(list_sum(p[j * 5 + 1 : j * 5 + 10]), 9) AS total FROM e""")
def w15_framing(spark, sf):
    x = framing.framed(series(spark, sf), 10, 5)
    return x.select("file", F.col("part").cast("int").alias("part"), "start", r9(F.aggregate("values", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(LISTS + """, n AS (SELECT file, len(p) AS bins, greatest(floor((len(p) - 10) / 5.0) + 1, 0)::INT AS k FROM series)
SELECT file, (CASE WHEN (CASE WHEN k > 0 THEN (k - 1) * 5 + 10 ELSE 0 END) < bins THEN k + 1 ELSE k END)::INT AS parts, (CASE WHEN (CASE WHEN k > 0 THEN (k - 1) * 5 + 10 ELSE 0 END) < bins THEN k * 5 + 1 ELSE (k - 1) * 5 + 1 END)::BIGINT AS last_start FROM n""")
def w16_mask_framing(spark, sf):
    s = series(spark, sf).withColumn("s", framing.frame_starts(F.size("values"), 10, 5, True))
    return s.select("file", F.size("s").alias("parts"), F.element_at("s", -1).alias("last_start"))


@query(FRAMES + ", n AS (SELECT file, count(*) AS bins FROM frames GROUP BY file) SELECT f.file, frame AS bin, round(prob, 9) AS value FROM frames f JOIN n ON f.file = n.file WHERE bins >= 10 AND frame <= floor((bins - 10) / 5.0) * 5 + 10")
def w17_overlap_average(spark, sf):
    return framing.overlap_average(framing.framed(series(spark, sf), 10, 5), 5).select("file", "bin", r9("value").alias("value"))


@query(FRAMES + " SELECT file, frame AS bin, round(prob, 9) AS value FROM frames")
def w18_stitch(spark, sf):
    s = series(spark, sf).withColumn("bins", F.size("values").cast("long"))
    return framing.stitch(framing.framed(s, 10, 5, keep_rest=True).withColumnRenamed("start", "start_bin")).select("file", "bin", r9("value").alias("value"))


@query(MASK + " SELECT file, floor((frame - 1) / 8.0)::BIGINT AS block, 2 * sum(active::INT) > count(*) AS active FROM mask GROUP BY ALL")
def w20_frame_mode(spark, sf):
    return framing.frame_mode(masked(spark, sf), 8)


@query(FRAMES + " SELECT file, frame, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(prob, 9) END AS prob FROM frames")
def w21_zero_where_silent(spark, sf):
    f = frames(spark, sf)
    return intervals.zero_where(f.select("file", "frame", "prob"), f.where("event_type = 'error'")).select("file", "frame", r9("prob").alias("prob"))


@query(REGIONS + " SELECT file, round(max(last - first + 1) * 0.05, 9) AS longest FROM regions GROUP BY file")
def w23_longest_run(spark, sf):
    return intervals.longest_run(masked(spark, sf), 0.05).select("file", r9("longest").alias("longest"))


@query(FRAMES + " SELECT file, frame, round(avg(prob) OVER (PARTITION BY file ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smooth, round(sqrt(avg(prob * prob) OVER (PARTITION BY file ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), 9) AS rms FROM frames")
def w24_x15_moving(spark, sf):
    return framing.moving_rms(framing.moving_mean(frames(spark, sf), 5), 4).select("file", "frame", r9("smooth").alias("smooth"), r9("rms").alias("rms"))


@query(FRAMES + ", d AS (SELECT file, frame, prob - lag(prob) OVER w AS diff FROM frames WINDOW w AS (PARTITION BY file ORDER BY frame)) SELECT file, frame, round(diff, 9) AS diff, coalesce(sign(diff) * sign(lag(diff) OVER (PARTITION BY file ORDER BY frame)) < 0, false) AS turn FROM d")
def w25_differences(spark, sf):
    return framing.differences(frames(spark, sf)).select("file", "frame", r9("diff").alias("diff"), "turn")


@query("WITH RECURSIVE " + FRAMES + ", m AS (SELECT file, 1::BIGINT AS frame, prob AS m FROM frames WHERE frame = 1 UNION ALL SELECT f.file, f.frame, 0.9 * m.m + 0.1 * f.prob FROM m JOIN frames f ON f.file = m.file AND f.frame = m.frame + 1) SELECT file, frame, round(m, 9) AS m FROM m")
def w26_recursive_mean(spark, sf):
    s = series(spark, sf).select("file", F.posexplode(framing.recursive_mean(F.col("values"), 0.1)).alias("k", "m"))
    return s.select("file", (F.col("k") + 1).cast("long").alias("frame"), r9("m").alias("m"))


@query("WITH RECURSIVE " + FRAMES + ", m AS (SELECT file, 1::BIGINT AS frame, value AS e, value AS m FROM frames WHERE frame = 1 UNION ALL SELECT f.file, f.frame, f.value, 0.975 * m.m + 0.025 * f.value FROM m JOIN frames f ON f.file = m.file AND f.frame = m.frame + 1) SELECT file, frame, round(pow(e / pow(1e-6 + m, 0.98) + 2, 0.5) - pow(2, 0.5), 7) AS pcen FROM m")
def w27_pcen(spark, sf):
    f = frames(spark, sf).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("p"))
    v = framing.pcen(F.transform("p", lambda x: x["value"]), 0.025)
    return f.select("file", F.posexplode(v).alias("k", "v")).select("file", (F.col("k") + 1).cast("long").alias("frame"), F.round("v", 7).alias("pcen"))


def _mid(level: float) -> str:
    """The percentile of a sorted list v at the midpoints of its values."""
    r = f"least(greatest({level} * len(v) / 100.0 + 0.5, 1), len(v))"
    return f"(v[floor({r})::INT] + ({r} - floor({r})) * (coalesce(v[floor({r})::INT + 1], v[floor({r})::INT]) - v[floor({r})::INT]))"


@query(FRAMES + f""", x AS (SELECT file, 20 * log10(value + pow(2, -52)) AS db FROM frames), m AS (SELECT file, avg(db) AS mean, median(db) AS median, coalesce(var_samp(db), 0) AS variance, max(db) - min(db) AS range, list_sort(list(db)) AS v FROM x GROUP BY file),
c AS (SELECT x.file, avg(pow(db - mean, 2)) AS m2, avg(pow(db - mean, 3)) AS m3, avg(pow(db - mean, 4)) AS m4 FROM x JOIN m ON x.file = m.file GROUP BY x.file),
s AS (SELECT m.file, mean, median, variance, range, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END AS skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 0 END AS kurt, ({_mid(99.9)} - {_mid(0.1)}) / nullif({_mid(75)} - {_mid(25)}, 0) AS spread FROM m JOIN c ON m.file = c.file),
t AS (SELECT file, 0.35 * least(variance / 15, 5) + 0.25 * greatest((sqrt(variance) - 3) / 2, 0) + 0.15 * greatest((range - 25) / 15, 0) + 0.1 * greatest((skew - 1) / 3, 0) + 0.1 * greatest((kurt - 4) / 5, 0) + 0.03 * greatest(coalesce((spread - 4) / 3, 0), 0) + 0.02 * abs(mean - median) / 2 AS score FROM s)
SELECT file, round(score, 9) AS score, score > 0.75 AS extreme FROM t""")
def a17_extreme_score(spark, sf):
    return metrics.extreme_score(frames(spark, sf), "value", ["file"]).select("file", r9("score").alias("score"), "extreme")


@query(FRAMES + ", n AS (SELECT *, count(*) OVER (PARTITION BY file) AS n, min(ts) OVER (PARTITION BY file) AS t0 FROM frames) SELECT file, frame, epoch_us(t0) + round((frame - 1) * (n / 250.0 / greatest(n - 1, 1)) * 1e6)::BIGINT AS at_us FROM n")
def w29_timeline(spark, sf):
    w = Window.partitionBy("file")
    x = frames(spark, sf).withColumns({"n": F.count("*").over(w), "t0": F.min("ts").over(w)})
    return x.select("file", "frame", micros(S.event_time(F.col("t0"), F.col("frame"), F.col("n"), F.lit(250.0))).alias("at_us"))


@query("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'FP' ELSE 'FN' END AS kind, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS decision FROM labels), p AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'FP' THEN 0 ELSE 1 END, doc_id) AS k FROM r) SELECT kind, min(CASE WHEN decision IS NULL THEN k END) AS next_undecided FROM p GROUP BY kind")
def w30_next_undecided(spark, sf):
    r = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "FP").otherwise("FN").alias("kind"), F.when(F.col("toxic") != 1, F.col("quality")).alias("decision"))
    n_fp = r.agg(F.count_if(F.col("kind") == "FP").alias("n_fp"))
    p = r.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))).crossJoin(F.broadcast(n_fp))
    k = F.col("k") + F.when(F.col("kind") == "FN", F.col("n_fp")).otherwise(0)
    return p.groupBy("kind").agg(F.min(F.when(F.col("decision").isNull(), k)).alias("next_undecided"))


@query(FRAMES + ", k AS (SELECT *, unnest(range(greatest(ceil((frame - 8) / 4.0), 0)::BIGINT, floor((frame - 1) / 4.0)::BIGINT + 1)) AS win FROM frames) SELECT file, win, round(avg(prob * prob), 9) AS power FROM k GROUP BY file, win HAVING count(*) = 8")
def w31_window_power(spark, sf):
    return framing.window_power(frames(spark, sf), 8).select("file", "win", r9("power").alias("power"))


@query("SELECT vec_id, list_max(embedding) <> list_min(embedding) AS valid FROM embeddings")
def f1_valid_signal(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.valid_signal(F.col("embedding")).alias("valid"))


@query("SELECT event_type, count(*) AS n, count_if(value IS NULL OR isnan(value))::BIGINT AS n_missing, count_if(value <= 0)::BIGINT AS n_not_positive, count_if(props IS NULL OR props = '')::BIGINT AS n_empty, count_if(value > 200)::BIGINT AS n_loud FROM events GROUP BY event_type")
def f3_f4_quality_counters(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_missing"), F.count_if(v <= 0).alias("n_not_positive"), F.count_if(F.col("props").isNull() | (F.col("props") == "")).alias("n_empty"), F.count_if(v > 200).alias("n_loud"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 0.2 * (SELECT avg(n_chars) FROM documents)")
def f7_long_enough(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.crossJoin(F.broadcast(d.agg(F.avg("n_chars").alias("m")))).where("n_chars >= 0.2 * m").select("doc_id", "n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE month(o_orderdate) IN (1, 2, 12) AND o_totalprice >= 100000")
def f8_month_and_size(spark, sf):
    return table(spark, sf, "orders").where(F.month("o_orderdate").isin(1, 2, 12) & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, sum(value) FILTER (event_type = 'click') > sum(value) FILTER (event_type = 'view') AND sum(value) FILTER (event_type = 'click') > sum(value) FILTER (event_type = 'error') AS dominant FROM events GROUP BY user_id")
def f9_dominant_band(spark, sf):
    s = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, sf, "events").groupBy("user_id").agg(((s("click") > s("view")) & (s("click") > s("error"))).alias("dominant"))


@query("SELECT event_type, count(DISTINCT user_id) AS rates, count(DISTINCT user_id) = 1 AS uniform FROM events GROUP BY event_type")
def f12_uniform(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("rates"), (F.count_distinct("user_id") == 1).alias("uniform"))


def detections(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("d_id"), F.col("ts").alias("d_time"), (F.col("value") / (F.col("value") + 50.0)).alias("score"))


def truth(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("t_id"), F.col("ts").alias("t_time"))


def matches(spark, sf):
    return matching.match_events(detections(spark, sf), truth(spark, sf), 3_600_000_000, ["user_id"])


@query("""WITH RECURSIVE d AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, list({'id': event_id, 't': epoch_us(ts)} ORDER BY ts, event_id) AS g FROM events WHERE event_type = 'view' GROUP BY user_id),
best AS (SELECT user_id, 0::BIGINT AS i, g, list_transform(range(len(g) + 1), lambda k: {'value': 0::BIGINT, 'pairs': []::STRUCT(d BIGINT, t BIGINT, gap BIGINT)[]}) AS b FROM v
UNION ALL SELECT user_id, i, g, list_transform(range(len(x)), lambda k: list_reduce(x[1:k + 1], lambda m, y: CASE WHEN y.value > m.value THEN y ELSE m END)) AS b
FROM (SELECT r.user_id, d.i, r.g, list_transform(range(len(r.g) + 1), lambda k: CASE WHEN k > 0 AND abs(r.g[k].t - d.t) <= 3600000000 AND r.b[k].value + 7200000000 - abs(r.g[k].t - d.t) > r.b[k + 1].value
THEN {'value': r.b[k].value + 7200000000 - abs(r.g[k].t - d.t), 'pairs': list_append(r.b[k].pairs, {'d': d.id, 't': r.g[k].id, 'gap': abs(r.g[k].t - d.t)})} ELSE r.b[k + 1] END) AS x FROM best r JOIN d ON d.user_id = r.user_id AND d.i = r.i + 1)),
ends AS (SELECT user_id, arg_max(b[len(b)].pairs, i) AS pairs FROM best GROUP BY user_id), p AS (SELECT user_id, unnest(pairs) AS p FROM ends)
SELECT user_id, p.d AS d_id, p.t AS t_id, p.gap AS gap_us FROM p""")
def j1_match_events(spark, sf):
    return matches(spark, sf)


@query("WITH n AS (SELECT t.event_id AS t_id, t.ts AS t_ts, d.event_id AS d_id, d.ts AS d_ts, abs(epoch_us(t.ts) - epoch_us(d.ts)) AS gap FROM events t JOIN events d ON t.user_id = d.user_id WHERE t.event_type = 'view' AND d.event_type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY gap, d_ts, d_id) AS k FROM n), u AS (SELECT *, row_number() OVER (PARTITION BY d_id ORDER BY t_ts, t_id) AS turn FROM r WHERE k = 1 AND gap <= 3600000000) SELECT t_id, d_id, gap AS gap_us FROM u WHERE turn = 1")
def j2_greedy_match(spark, sf):
    return matching.greedy_match(detections(spark, sf), truth(spark, sf), 3_600_000_000, "user_id")


_ASOF = "p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id AS sid, ts AS sts FROM events WHERE event_type = 'signup')"


@query("WITH " + _ASOF + " SELECT p.event_id, s.sid AS found FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.sts")
def j3_as_of(spark, sf):
    e = table(spark, sf, "events")
    right = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("sid"), F.col("ts").alias("sts"))
    return matching.as_of(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "sts", "sid").select("event_id", "found")


@query("WITH " + _ASOF + ", d AS (SELECT user_id, avg(x) AS mean FROM (SELECT user_id, epoch_us(sts) - epoch_us(lag(sts) OVER (PARTITION BY user_id ORDER BY sts)) AS x FROM s) GROUP BY user_id), a AS (SELECT p.user_id, p.event_id, p.ts, s.sid, s.sts FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.sts) SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(sts) <= mean THEN sid END AS found FROM a LEFT JOIN d ON a.user_id = d.user_id")
def j4_as_of_within(spark, sf):
    e = table(spark, sf, "events")
    right = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("sid"), F.col("ts").alias("sts"))
    return matching.as_of_within(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "sts", "sid").select("event_id", "found")


@query("WITH " + _ASOF + " SELECT p.event_id, max_by(s.sid, (s.sts, s.sid)) AS found FROM p LEFT JOIN s ON p.ts >= s.sts GROUP BY p.event_id")
def j3_as_of_any_key(spark, sf):
    e = table(spark, sf, "events")
    right = e.where("event_type = 'signup'").select(F.col("event_id").alias("sid"), F.col("ts").alias("sts"))
    return matching.as_of(e.where("event_type = 'purchase'").select("event_id", "ts"), right, [], "ts", "sts", "sid", slice_us=86_400_000_000).select("event_id", "found")


@query("WITH f AS (SELECT user_id, event_id AS file, ts AS s, lead(ts) OVER w AS next_s, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT file, CASE WHEN next_s < s + INTERVAL 2 HOUR THEN nxt ELSE file END AS end_file FROM f")
def j5_spill(spark, sf):
    e = table(spark, sf, "events")
    files = e.select("user_id", F.col("event_id").alias("file"), F.col("ts").alias("file_start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("file_end"))
    ev = e.select("user_id", F.col("event_id").alias("file"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("event_end"))
    return matching.spill(ev, files, ["user_id"]).select("file", "end_file")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j7_j11_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def j9_stable_distinct(spark, sf):
    return sampling.stable_distinct(table(spark, sf, "documents"), "source", "doc_id")


@query(MASK + " SELECT file, frame, active OR event_type = 'error' AS active FROM mask")
def j10_j12_mask_union(spark, sf):
    m = masked(spark, sf)
    return matching.mask_union(m, m.withColumn("active", F.col("event_type") == "error"), ["file", "frame"])


@query(FRAMES + ", t AS (SELECT unnest(range(10)) AS k) SELECT k::INT AS param, count_if(prob > 0.05 + 0.1 * k)::BIGINT AS n FROM frames, t GROUP BY k")
def j13_sweep(spark, sf):
    params = spark.range(10).select(F.col("id").cast("int").alias("param"), (0.05 + 0.1 * F.col("id")).alias("on"))
    return matching.cross(params, frames(spark, sf).select("prob")).groupBy("param").agg(F.count_if(F.col("prob") > F.col("on")).alias("n"))


_SHAPE = "count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std, round(var_samp(value), 4) AS var, round(median(value), 9) AS median, round(stddev_samp(value) / avg(value), 8) AS variation, round(kurtosis_pop(value) + 3, 6) AS kurt"


@query(f"SELECT event_type, {_SHAPE}, round((avg(value * value * value) - 3 * avg(value) * var_pop(value) - pow(avg(value), 3)) / pow(stddev_pop(value), 3), 6) AS skew FROM events GROUP BY event_type")
def a1_a4_shape(spark, sf):
    x = metrics.shape(table(spark, sf, "events"), "value", ["event_type"])
    digits = {"mean": 6, "std": 6, "var": 4, "median": 9, "variation": 8, "kurt": 6, "skew": 6}
    return x.select("event_type", "n", "least", "most", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), l AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0])::DOUBLE AS level), p AS (SELECT event_type, level, least(greatest(level * n / 100 + 0.5, 1.0), n) AS r, k, value FROM s, l) SELECT event_type, level, round(max(CASE WHEN k = floor(r) THEN value END) + CASE WHEN max(r - floor(r)) > 0 THEN max(r - floor(r)) * (max(CASE WHEN k = floor(r) + 1 THEN value END) - max(CASE WHEN k = floor(r) THEN value END)) ELSE 0 END, 6) AS percentile FROM p GROUP BY event_type, level")
def a2_percentiles(spark, sf):
    x = metrics.midpoint_percentiles(table(spark, sf, "events"), "value", [1, 5, 10, 25, 50, 75, 90, 95, 99], ["event_type"])
    return x.select("event_type", "level", F.round("percentile", 6).alias("percentile"))


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type), d AS (SELECT e.event_type, m, median(abs(value - m)) AS d FROM events e JOIN m ON e.event_type = m.event_type GROUP BY ALL) SELECT e.event_type, round(m, 9) AS median, round(d, 9) AS mad, count_if(abs(value - m) > 5 * d)::BIGINT AS outliers FROM events e JOIN d ON e.event_type = d.event_type GROUP BY ALL")
def a3_a21_mad(spark, sf):
    return metrics.mad(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", r9("median").alias("median"), r9("mad").alias("mad"), "outliers")


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM c) SELECT lang, source AS mode FROM r WHERE k = 1")
def a5_mode(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.mode("source", True).alias("mode"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first_ts, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def a6_by_file(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT month(o_orderdate)::INT AS month, o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def a7_cross_tab(spark, sf):
    return table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


_COUNTS = "c AS (SELECT lang, count_if(quality = 1 AND toxic = 1)::BIGINT AS tp, count_if(quality = 1 AND toxic = 0)::BIGINT AS fp, count_if(quality = 0 AND toxic = 1)::BIGINT AS fn, count_if(quality = 0 AND toxic = 0)::BIGINT AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def counts(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    both = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return x.groupBy("lang").agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"), both(0, 0).alias("tn"))


@query("WITH " + _COUNTS + ", p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c) SELECT lang, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1 FROM p")
def a8_precision_recall(spark, sf):
    x = metrics.precision_recall(counts(spark, sf))
    return x.select("lang", "tp", "fp", "fn", "tn", *[r9(c).alias(c) for c in ("precision", "recall", "f1")])


_SCORED = "x AS (SELECT event_type, round(value, 0) AS score, user_id % 2 = 0 AS hit FROM events), g AS (SELECT event_type, score, sum(hit::INT) AS p, sum(1 - hit::INT) AS q FROM x GROUP BY ALL), c AS (SELECT event_type, score, sum(p) OVER (PARTITION BY event_type ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY event_type ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY event_type) AS p, sum(q) OVER (PARTITION BY event_type) AS q FROM g)"


def scored(spark, sf):
    return table(spark, sf, "events").select("event_type", F.round("value", 0).alias("score"), (F.col("user_id") % 2 == 0).alias("hit"))


@query("WITH " + _SCORED + " SELECT event_type, score, round(fp / q, 9) AS fpr, round(tp / p, 9) AS tpr FROM c")
def a9_roc(spark, sf):
    return metrics.roc(scored(spark, sf), "score", "hit", ["event_type"]).select("event_type", "score", r9("fpr").alias("fpr"), r9("tpr").alias("tpr"))


@query("WITH " + _SCORED + ", r AS (SELECT event_type, score, fp / q AS f, tp / p AS t FROM c), a AS (SELECT event_type, (f - coalesce(lag(f) OVER w, 0)) * (t + coalesce(lag(t) OVER w, 0)) / 2 AS a FROM r WINDOW w AS (PARTITION BY event_type ORDER BY score DESC)) SELECT event_type, round(sum(a), 8) AS auc FROM a GROUP BY event_type")
def a9_auc(spark, sf):
    return metrics.auc(scored(spark, sf), "score", "hit", ["event_type"]).select("event_type", F.round("auc", 8).alias("auc"))


@query("WITH " + _SCORED + ", s AS (SELECT *, max(score) OVER w AS most, min(score) OVER w AS least, CASE WHEN score = 0 THEN 5e-324 ELSE pow(2.0, floor(log2(abs(CASE WHEN score = 0 THEN 1 ELSE score END))) - 52) END AS eps FROM c WINDOW w AS (PARTITION BY event_type)), a AS (SELECT event_type, score, tp, fp FROM s UNION ALL SELECT event_type, score + eps, 0, 0 FROM s WHERE score = most UNION ALL SELECT event_type, score - eps, tp, fp FROM s WHERE score = least) SELECT event_type, score, round(tp / 5000.0, 9) AS tpr, round(fp / 86400.0, 9) AS alarms_per_s FROM a")
def a10_alarm_curve(spark, sf):
    x = metrics.alarm_curve(scored(spark, sf), "score", "hit", 5000, 86400.0, ["event_type"])
    return x.select("event_type", "score", r9("tpr").alias("tpr"), r9("alarms_per_s").alias("alarms_per_s"))


@query("WITH f AS (SELECT user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS d FROM events GROUP BY user_id) SELECT sum(d)::BIGINT AS total_us, count(*) AS files FROM f")
def a11_a12_total_duration(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id").agg((F.max(micros("ts")) - F.min(micros("ts"))).alias("d"))
    return f.agg(F.sum("d").alias("total_us"), F.count("*").alias("files"))


@query("WITH " + _COUNTS + " SELECT lang, round(100.0 * tp / (tp + fn), 9) AS tp_pct, round(100.0 * fp / (fp + tn), 9) AS fp_pct FROM c")
def a13_confusion(spark, sf):
    return metrics.confusion(counts(spark, sf)).select("lang", r9("tp_pct").alias("tp_pct"), r9("fp_pct").alias("fp_pct"))


_DECISIONS = "d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'FP' ELSE 'FN' END AS kind, CASE WHEN quality = 1 AND toxic = 0 THEN 'DiscreteCallsPresent' WHEN quality = 1 THEN 'DiscreteCallsChorusPresent' WHEN toxic = 1 THEN 'ChorusPresent' ELSE 'CallChorusAbsent' END AS decision FROM labels)"
_FLIPS = _DECISIONS + ", l AS (SELECT unnest(['inclusive', 'discrete_only', 'strict_discrete', 'chorus_aware']) AS logic), f AS (SELECT doc_id, kind, decision, logic, CASE WHEN kind = 'FN' THEN decision = 'CallChorusAbsent' WHEN logic = 'inclusive' THEN decision <> 'CallChorusAbsent' WHEN logic = 'strict_discrete' THEN decision = 'DiscreteCallsPresent' ELSE decision IN ('DiscreteCallsPresent', 'DiscreteCallsChorusPresent') END AS flips FROM d, l)"


def decided(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "FP").otherwise("FN").alias("kind"), F.when(q & ~t, "DiscreteCallsPresent").when(q, "DiscreteCallsChorusPresent").when(t, "ChorusPresent").otherwise("CallChorusAbsent").alias("decision"))


@query("WITH " + _DECISIONS + " SELECT kind, decision, count(*) AS n FROM d GROUP BY ALL")
def a14_decisions(spark, sf):
    return decided(spark, sf).groupBy("kind", "decision").agg(F.count("*").alias("n"))


@query("WITH " + _DECISIONS + " SELECT kind, round(avg((decision LIKE '%Chorus%Present')::INT), 9) AS prevalence FROM d GROUP BY kind")
def a15_chorus_prevalence(spark, sf):
    return decided(spark, sf).groupBy("kind").agg(r9(F.avg(F.col("decision").like("%Chorus%Present").cast("int"))).alias("prevalence"))


@query("WITH " + _FLIPS + " SELECT doc_id, logic, flips FROM f")
def x25_decision_logic(spark, sf):
    return metrics.reclassify(decided(spark, sf)).select("doc_id", "logic", "flips")


@query("WITH " + _FLIPS + ", g AS (SELECT logic, count_if(kind = 'FP' AND flips)::BIGINT AS a, count_if(kind = 'FN' AND flips)::BIGINT AS b FROM f GROUP BY logic) SELECT logic, a AS fp_to_tp, b AS fn_to_tn, 10000 + a - b AS truth, 5000 + a AS tp, round((5000 + a) / (10000 + a - b), 9) AS recall, round((5000 + a) / 20000, 9) AS precision FROM g")
def a16_adjudicated(spark, sf):
    x = metrics.adjudicated(metrics.reclassify(decided(spark, sf)), 10000, 5000, 20000)
    return x.select("logic", "fp_to_tp", "fn_to_tn", "truth", "tp", r9("recall").alias("recall"), r9("precision").alias("precision"))


@query(FRAMES + """, k AS (SELECT file, prob, frame AS k, count(*) OVER (PARTITION BY file) AS n, prob - lag(prob) OVER (PARTITION BY file ORDER BY frame) AS d FROM frames),
t AS (SELECT *, CASE WHEN lag(d) OVER (PARTITION BY file ORDER BY k) IS NOT NULL AND sign(d) <> sign(lag(d) OVER (PARTITION BY file ORDER BY k)) THEN 1 ELSE 0 END AS turn FROM k),
g AS (SELECT file, max(n) AS n, arg_min(prob, k) AS first, arg_max(prob, k) AS final, avg(prob) FILTER (k > n - 10) AS m, coalesce(stddev_samp(prob) FILTER (k > n - 10), 0) AS sd, sum(turn) AS turns, stddev_samp(d) AS dsd, avg(abs(d)) AS dm,
  regr_slope(CASE WHEN k >= ceil(n / 2.0) THEN prob END, CASE WHEN k >= ceil(n / 2.0) THEN k::DOUBLE END) AS slope FROM t GROUP BY file)
SELECT file, round(CASE WHEN first <> 0 THEN 100 * (first - final) / first ELSE 0 END, 7) AS reduction_pct, round(m, 9) AS recent_mean, round(sd, 9) AS recent_std, CASE WHEN m > 0 THEN sd / m ELSE 0 END < 0.01 AS converged,
  round(CASE WHEN n > 5 THEN turns / (n - 1) ELSE 0 END, 9) AS turn_ratio, n > 5 AND turns / (n - 1) > 0.5 AS oscillating, n > 5 AND final > first AS increasing, round(CASE WHEN n > 5 THEN dsd / dm ELSE 0 END, 7) AS stability, round(slope, 8) AS late_slope FROM g""")
def a22_a24_loss(spark, sf):
    x = metrics.loss_analysis(frames(spark, sf), "prob", "frame", ["file"])
    return x.select("file", *[F.round(c, d).alias(c) for c, d in (("reduction_pct", 7), ("recent_mean", 9), ("recent_std", 9), ("turn_ratio", 9), ("stability", 7), ("late_slope", 8))], "converged", "oscillating", "increasing")


@query(FRAMES + ", d AS (SELECT file, event_type <> lag(event_type) OVER w AS c, prob > lag(prob) OVER w AS b FROM frames WINDOW w AS (PARTITION BY file ORDER BY frame)) SELECT file, sum(c::INT)::BIGINT AS changes, round(avg(b::INT), 9) AS bad_ratio FROM d GROUP BY file")
def a25_rate_changes(spark, sf):
    return metrics.rate_changes(frames(spark, sf), "event_type", "prob", "frame", ["file"]).select("file", "changes", r9("bad_ratio").alias("bad_ratio"))


@query(FRAMES + """, n AS (SELECT file, frame, prob, count(*) OVER (PARTITION BY file) AS n FROM frames), h AS (SELECT *, least(5, ceil(n / 10.0))::INT AS width FROM n),
m AS (SELECT a.file, a.frame, a.prob, a.n, (SELECT avg(b.prob) FROM frames b WHERE b.file = a.file AND b.frame BETWEEN a.frame - a.width // 2 AND a.frame + (a.width - 1) // 2) AS m FROM h a),
r AS (SELECT *, (m - lead(m) OVER (PARTITION BY file ORDER BY frame)) / m AS r FROM m), p AS (SELECT file, max(n) AS n, min(frame) FILTER (n > 10 AND r < 0.001) AS k FROM r GROUP BY file)
SELECT p.file, coalesce(k, p.n)::BIGINT AS plateau, round(CASE WHEN p.n > 10 THEN 100.0 * coalesce(k, p.n) / p.n ELSE 100.0 END, 9) AS plateau_pct, coalesce(p.n - k > 0.3 * p.n AND f.prob > 0.01, false) AS premature FROM p LEFT JOIN frames f ON f.file = p.file AND f.frame = p.k""")
def a26_convergence(spark, sf):
    return metrics.convergence(frames(spark, sf), "prob", "frame", ["file"]).select("file", "plateau", r9("plateau_pct").alias("plateau_pct"), "premature")


@query(FRAMES + " SELECT file, round(count_if(prob > 0.5)::BIGINT * 0.85, 9) AS seconds_active, bool_or(isnan(prob)) AS any_nan, bool_and(isnan(prob)) AS all_nan FROM frames GROUP BY file")
def a30_a31_flags(spark, sf):
    n = F.isnan("prob")
    return frames(spark, sf).groupBy("file").agg(r9(F.count_if(F.col("prob") > 0.5) * 0.85).alias("seconds_active"), F.bool_or(n).alias("any_nan"), F.bool_and(n).alias("all_nan"))


@query("SELECT o_orderstatus AS status, list_sum(list(o_orderkey))::BIGINT AS total, count(*)::INT AS n FROM orders GROUP BY ALL")
def a33_collect(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.collect_list("o_orderkey").alias("keys"))
    return g.select("status", F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("keys").alias("n"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def t1_t2_top(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(5)


@query("SELECT doc_id FROM documents ORDER BY md5('1|' || doc_id), doc_id LIMIT 50")
def t4_sample(spark, sf):
    return sampling.sample_rows(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.8) AS train FROM documents")
def t5_split(spark, sf):
    return sampling.split_exact(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 0.8, "lang").select("doc_id", "train")


@query("WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT avg(n_chars) AS mean, count(*) AS c FROM documents), q AS (SELECT lang, source, n, least(n, ceil(200000 * (n / c) / mean)) AS quota FROM g, m), x AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, n, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY md5('1|' || d.doc_id), d.doc_id) AS r, quota FROM documents d JOIN q ON d.lang = q.lang AND d.source = q.source), y AS (SELECT * FROM x WHERE r <= quota), s AS (SELECT lang, source, n, sum(n_chars) AS d FROM y GROUP BY ALL), k AS (SELECT lang, source, sum(d) OVER (ORDER BY n DESC, lang, source) - d AS b FROM s) SELECT y.doc_id FROM y JOIN k ON y.lang = k.lang AND y.source = k.source WHERE b < 200000")
def t6_stratified(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return sampling.stratified(d, ["lang", "source"], "doc_id", "n_chars", 200000.0).select("doc_id")


@query("WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS b FROM documents) SELECT doc_id FROM s WHERE b < 50000")
def t7_until(spark, sf):
    return sampling.until(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "n_chars", 50000, "lang").select("doc_id")


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, least(greatest(floor((o_totalprice - lo) / (hi - lo) * 5) + 1, 1), 5)::INT AS bin FROM orders, e")
def t9_bins(spark, sf):
    return sampling.equal_width_bins(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "bin").select("o_orderkey", "bin")


@query("SELECT event_id, CASE WHEN event_id % 8 < 7 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
def x1_time_from_name(spark, sf):
    styles = (("x", "yyyyMMdd_HHmmss"), ("", "yyyyMMdd-HHmmss"), ("H08S1_", "yyMMdd-HHmmss"), ("", "yyyy-MM-dd_HH-mm-ss"), ("", "yyyy-MM-dd-HH:mm:ss"), ("", "yyyyMMdd_HH:mm:ss"), ("12_", "yyyy-MM-dd_HH-mm-ss"), ("noise", "yyyy"))
    name = F.element_at(F.array(*[F.concat(F.lit(a), F.date_format("ts", f)) for a, f in styles]), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("/a/"), name, F.lit(".wav")).alias("path"))
    return e.select("event_id", micros(S.time_from_name(S.file_stem(F.col("path")))).alias("us"))


@query("SELECT event_id, epoch_us(date_trunc('millisecond', ts)) AS us FROM events")
def x2_time_from_stamp(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy/M/d HH:mm:ss.SSS").alias("s"))
    return e.select("event_id", micros(S.time_from_stamp(F.col("s"))).alias("us"))


@query("SELECT event_id, round(epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE + 719529, 7) AS day, hour(ts)::INT AS hour FROM events")
def x3_day_number(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.day_number(F.col("ts")), 7).alias("day"), S.hour_of_day(S.day_number(F.col("ts"))).alias("hour"))


@query(FRAMES + ", q AS (SELECT event_id, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM frames) SELECT event_id, round(1 / (1 + exp(-ln(p / (1 - p)) / 2.0)), 9) AS scaled, round(ln(p / (1 - p)), 8) AS logit FROM q")
def x6_temperature_scaling(spark, sf):
    return frames(spark, sf).select("event_id", r9(S.scaled_probability(F.col("prob"), 2.0)).alias("scaled"), F.round(S.logit(F.col("prob")), 8).alias("logit"))


@query("WITH RECURSIVE " + FRAMES + """, q AS (SELECT least(greatest(prob, 1e-7), 1 - 1e-7) AS q, event_id % 10 < prob * 10 AS hit FROM frames), z AS (SELECT round(ln(q / (1 - q)), 9) AS z, hit, count(*) AS n FROM q GROUP BY ALL),
g(k, lo, hi) AS (SELECT 0, 0.01::DOUBLE, 10::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN left_loss < right_loss THEN lo ELSE a END, CASE WHEN left_loss < right_loss THEN b ELSE hi END FROM (SELECT k, lo, hi, a, b,
    -sum(n * ln(CASE WHEN hit THEN 1 / (1 + exp(-z / a)) ELSE 1 - 1 / (1 + exp(-z / a)) END + 1e-300)) AS left_loss, -sum(n * ln(CASE WHEN hit THEN 1 / (1 + exp(-z / b)) ELSE 1 - 1 / (1 + exp(-z / b)) END + 1e-300)) AS right_loss
    FROM (SELECT *, hi - (sqrt(5) - 1) / 2 * (hi - lo) AS a, lo + (sqrt(5) - 1) / 2 * (hi - lo) AS b FROM g WHERE k < 60), z GROUP BY k, lo, hi, a, b))
SELECT round((lo + hi) / 2, 3) AS temperature FROM g WHERE k = 60""")
def x7_best_temperature(spark, sf):
    t = metrics.best_temperature(frames(spark, sf).select("prob", (F.col("event_id") % 10 < F.col("prob") * 10).alias("hit")), "prob", "hit")
    return spark.createDataFrame([(None if t is None else round(t, 3),)], "temperature double")


@query("SELECT event_id, round(20 * log10(abs(value) + pow(2, -52)), 8) AS amplitude_db, round(10 * log10(greatest(value, 1e-10)), 8) AS power_db, round(value / max(value) OVER (PARTITION BY user_id), 9) AS peak FROM events")
def x8_x9_levels(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(S.amplitude_db(v), 8).alias("amplitude_db"), F.round(S.power_db(v), 8).alias("power_db"), r9(v / F.max("value").over(Window.partitionBy("user_id"))).alias("peak"))


@query("SELECT event_id, round((value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 1e-10), 7) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def x10_z_score(spark, sf):
    w = Window.partitionBy("user_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_samp("value").over(w), F.lit(1e-10))
    return table(spark, sf, "events").select("event_id", F.round(z, 7).alias("z"))


@query("SELECT event_id, round(2 + 5 * exp(-0.003 * value) + 5 * exp(-0.0001 * value), 9) AS delta, (2 * round(value * 0.01 * 250 / 2))::BIGINT AS window_len, (floor(round(value)::BIGINT * 100 / 12.0) + 1)::BIGINT AS n_frames, ceil(value / 60.0)::BIGINT AS pages FROM events")
def x16_x18_x29_lengths(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", r9(S.pcen_delta(v)).alias("delta"), S.even_length(v * 0.01, F.lit(250)).alias("window_len"), S.frame_count(F.round(v).cast("long") * 100, F.lit(212), F.lit(12), F.lit(106)).alias("n_frames"), S.clip_pages(v, 60.0).alias("pages"))


@query("SELECT y::INT AS year, round(32.97 - 0.33 * (y - 2017), 9) AS f FROM (SELECT unnest(range(2000, 2026)) AS y)")
def x21_frequency_drift(spark, sf):
    y = spark.range(2000, 2026).select(F.col("id").cast("int").alias("year"))
    return y.select("year", r9(S.drifted_frequency(F.lit(32.97), F.lit(0.33), F.lit(2017), F.col("year"))).alias("f"))


@query("SELECT user_id, round(sqrt(avg(value) FILTER (event_type = 'view') * pow(10, 0.5) / avg(value) FILTER (event_type = 'click')), 8) AS gain FROM events GROUP BY user_id")
def x22_snr_gain(spark, sf):
    a = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(S.snr_gain(a("click"), a("view"), F.lit(5.0)), 8).alias("gain"))


@query(MERGED + ", n AS (SELECT file, count(*) AS total FROM frames GROUP BY file), c AS (SELECT m.file, first, last, total, greatest(5, ceil((40 - (last - first)) / 2.0)) AS more FROM merged m JOIN n ON m.file = n.file) SELECT file, first, last, greatest(first - more, 1)::BIGINT AS context_start, least(last + more, total)::BIGINT AS context_end FROM c")
def x26_context(spark, sf):
    n = frames(spark, sf).groupBy("file").agg(F.count("*").alias("total"))
    a, b = S.context_window(F.col("first"), F.col("last"), F.lit(40), F.lit(5), F.col("total"))
    return merged(spark, sf).join(n, "file").select("file", "first", "last", a.alias("context_start"), b.alias("context_end"))


from . import more, sound  # noqa: E402, F401

# MASK, REGIONS and the like start a WITH list; statements that begin with one get the keyword here
for _name, _sql in ORACLE.items():
    if _sql.startswith("frames AS"):
        ORACLE[_name] = "WITH " + _sql
