"""Registered queries for sound: WAV bytes, signal code on arrays, training sequences and their pairs.

A file's series of probabilities stands for its samples. What has no SQL is random or numeric signal code that tests hold
against brute force or known signals.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import intervals, synthesis
from ..sources import recordings
from .queries import FRAMES, LISTS, frames, query, r9, series, table


def total(c):
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


@query(LISTS + " SELECT file::VARCHAR AS path, 250 AS fs, len(p)::BIGINT AS n, (44 + 2 * len(p))::BIGINT AS bytes, round(list_sum(list_transform(p, lambda x: trunc(least(x, 1 - 1 / 32768.0) * 32768) / 32768.0)), 9) AS total FROM series")
def s2_s3_s12_wav_round_trip(spark, sf):
    arrays.ship(spark)
    wav = recordings.with_wav(series(spark, sf).withColumn("path", F.col("file").cast("string")), "values", 250)
    x = recordings.read(wav).join(recordings.headers(wav).select("path", "bytes"), "path")
    return x.select("path", "fs", "n", "bytes", r9(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))).alias("total"))


@query(LISTS + """, v AS (SELECT file, p, len(p) AS n, list_filter(range(1, len(p) - 1), lambda i: p[i + 1] <= p[i] AND p[i + 1] <= p[i + 2]) AS low FROM series),
a AS (SELECT *, list_sort(list_transform(low, lambda i: {'d': abs(i - 1 * (n - 1) / 3.0), 'i': i}))[1].i AS one FROM v),
b AS (SELECT *, list_sort(list_transform(list_filter(low, lambda i: i <> one), lambda i: {'d': abs(i - 2 * (n - 1) / 3.0), 'i': i}))[1].i AS two FROM a)
SELECT file, array_to_string(list_sort(list_filter([one, two], lambda x: x IS NOT NULL)), ',') AS places FROM b""")
def w12_split_points(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", F.array_join(arrays.split_points("values", 3).cast("array<string>"), ",").alias("places"))


@query()
def w13_band_energy_minima(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", arrays.band_energy_minima("values", 250, 10, 60, 5, 3).alias("places"))


@query()
def w19_silence(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", F.size(F.filter(arrays.silent("values", 250, 0.01), lambda x: x)).alias("silent"))


@query()
def w22_changes(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", arrays.changes("values", 0.05).alias("places"))


@query()
def w22_event_segments(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", arrays.event_segments("values", 2, 2, 3, 0.05, (1.0, 8.0)).alias("segments"))


@query(FRAMES + """, n AS (SELECT file, count(*) AS n FROM frames GROUP BY file), b AS (SELECT file, frame AS first, n FROM frames JOIN n USING (file) WHERE event_type = 'purchase' OR frame IN (1, n)),
l AS (SELECT *, lead(first) OVER (PARTITION BY file ORDER BY first) AS nxt FROM b) SELECT file, first, CASE WHEN nxt = n THEN n - 1 ELSE least(nxt + 3, n) END AS last FROM l WHERE nxt IS NOT NULL""")
def w22_overlap_segments(spark, sf):
    f = frames(spark, sf)
    return intervals.overlap_segments(f.where("event_type = 'purchase'"), f.groupBy("file").agg(F.count("*").alias("n")), ["file"], "frame", "n", 4)


@query()
def x11_x12_mel_spectrum(spark, sf):
    arrays.ship(spark)
    return series(spark, sf).select("file", F.posexplode(arrays.mel_spectrum("values", 250, 16, 4, 10, 100, 8)).alias("frame", "power"))


@query()
def x13_x14_resample_filter(spark, sf):
    arrays.ship(spark)
    x = series(spark, sf).withColumn("half", arrays.resample("values", 250, 125)).withColumn("low", arrays.band_pass("values", 250, None, 60))
    return x.select("file", F.size("half").alias("n"), r9(total("low")).alias("total"))


@query(LISTS + ", i AS (SELECT file, p, len(p) AS n, unnest(range(150)) AS i FROM series) SELECT file, count(*)::BIGINT AS n, round(sum((i + 1) * p[CASE WHEN i % (2 * n) < n THEN i % (2 * n) ELSE 2 * n - 1 - i % (2 * n) END + 1]), 6) AS weighted FROM i GROUP BY file")
def x23_recycle(spark, sf):
    x = series(spark, sf).select("file", F.posexplode(arrays.recycle("values", 150)).alias("i", "v"))
    return x.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum((F.col("i") + 1) * F.col("v")), 6).alias("weighted"))


_LAG = FRAMES + """, b AS (SELECT file, frame - 5 AS frame, prob FROM frames WHERE frame > 5), c AS (SELECT a.file, a.frame - b.frame AS lag, sum(a.prob * b.prob) AS s FROM frames a JOIN b ON a.file = b.file GROUP BY ALL)
SELECT file, arg_max(lag, s)::INT AS lag FROM c GROUP BY file"""


@query(_LAG)
def x28_lag(spark, sf):
    arrays.ship(spark)
    s = series(spark, sf).where(F.size("values") > 5)
    return s.select("file", arrays.lag_of_best_match("values", F.slice("values", F.lit(6), F.size("values") - 5)).alias("lag"))


def beds(spark, sf):
    """Each file as noise, its first 12 and 9 samples as calls."""
    calls = F.array(F.slice("values", 1, 12), F.slice("values", 1, 9))
    return series(spark, sf).select(F.col("file").alias("id"), calls.alias("calls"), arrays.recycle("values", 500).alias("noise"))


def made(x):
    return x.select("id", F.size("samples").alias("n"), F.aggregate("mask", F.lit(0), lambda s, v: s + v.cast("int")).alias("marked"), r9(F.array_max(F.transform("samples", F.abs))).alias("most"))


@query("SELECT user_id AS id, 500 AS n, 21 AS marked, 1.0::DOUBLE AS most FROM events GROUP BY user_id HAVING count(*) >= 12")
def g1_multi_call(spark, sf):
    return made(synthesis.multi_call_sequences(beds(spark, sf).where("size(calls[0]) = 12"), 250, 0.05, (5.0, 10.0), 1))


@query("SELECT user_id AS id, 36 AS n, 12 AS marked, 0.99::DOUBLE AS most FROM events GROUP BY user_id HAVING count(*) >= 12")
def g2_single_call(spark, sf):
    return made(synthesis.single_call_sequences(beds(spark, sf).where("size(calls[0]) = 12"), 250, (10.0, 60.0), (5.0, 10.0), 1))


@query()
def g3_bouts_of_one(spark, sf):
    return made(synthesis.bout_sequences(beds(spark, sf), 250, 0.1, 0.02, (5.0, 10.0), False, 1))


@query()
def g3_bouts_of_many(spark, sf):
    return made(synthesis.bout_sequences(beds(spark, sf), 250, 0.1, 0.02, (5.0, 10.0), True, 1))


@query(FRAMES + """, n AS (SELECT file, count(*) AS bins FROM frames GROUP BY file), j AS (SELECT file, unnest(range(greatest(floor((bins - 10) / 5.0) + 1, 0)::INT)) AS j FROM n),
f AS (SELECT f.file, j, frame - j * 5 AS k, prob, avg(prob) OVER w AS m, stddev_samp(prob) OVER w AS d FROM frames f JOIN j ON f.file = j.file AND frame BETWEEN j * 5 + 1 AND j * 5 + 10 WINDOW w AS (PARTITION BY f.file, j))
SELECT file, (j + 1)::INT AS part, (j * 5 + 1)::BIGINT AS start, round(sum(k * (prob - m) / greatest(d, 1e-10)), 6) AS weighted, count_if(prob >= 0.5)::BIGINT AS marked FROM f GROUP BY file, j""")
def g5_frame_pairs(spark, sf):
    s = series(spark, sf).select("file", F.col("values").alias("x"), F.transform("values", lambda v: (v >= 0.5).cast("long")).alias("t"))
    f = synthesis.frame_pairs(s, 10, 5)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return f.select("file", F.col("part").cast("int").alias("part"), "start", F.round(weighted, 6).alias("weighted"), F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a + v).alias("marked"))


@query("""WITH o AS (SELECT o_custkey, o_totalprice AS x, o_orderkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, k::INT AS place, x, t FROM o WHERE k <= n - 1""")
def g6_zip_lists(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o"))
    o = o.select("o_custkey", F.col("o.o_totalprice").alias("x"), F.slice("o.o_orderkey", F.lit(1), F.size("o") - 1).alias("t"))
    return synthesis.zip_lists(o)


@query("WITH f AS (SELECT CASE WHEN event_type = 'error' THEN 0.1 ELSE value * 10 / 250.0 END AS s FROM events ORDER BY event_id LIMIT 10) SELECT round(coalesce(avg(s) FILTER (s > 0), 0.1), 9) AS seconds FROM f")
def g7_mean_clip_duration(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") * 10).alias("samples"), F.lit(250.0).alias("fs"), (F.col("event_type") != "error").alias("valid"))
    return synthesis.mean_clip_duration(e, "samples", "fs", "valid", "event_id").select(r9("seconds").alias("seconds"))


@query("""WITH d AS (SELECT doc_id, n_chars + 600.0 AS duration, 10.0 + doc_id % 7 AS call, 60.0 + doc_id % 11 AS apart, 1 + doc_id % 90 AS clean FROM documents), c AS (SELECT *, floor((duration * 0.45 + apart) / (call + apart))::BIGINT AS calls FROM d)
SELECT doc_id, calls, (100 * ceil(ceil(calls * 1200 / clean::DOUBLE) / 100))::BIGINT AS copies, (100 * ceil(ceil(round((600 + 600) * floor(duration / (apart + 5)) * 0.6 * 1.2, 6)) / 100))::BIGINT AS needed FROM c""")
def x20_calls_and_copies(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 600.0).alias("duration"), (k % 7 + 10.0).alias("call"), (k % 11 + 60.0).alias("apart"), (k % 90 + 1).alias("clean"))
    d = d.withColumn("calls", synthesis.calls_per_sequence(F.col("duration"), F.col("call"), F.col("apart")))
    return d.select("doc_id", "calls", synthesis.copies_per_call(F.col("calls"), F.lit(1200), F.col("clean")).alias("copies"), synthesis.clean_samples_needed(F.lit(1200), F.col("duration"), F.col("apart"), F.lit(5)).alias("needed"))


def by_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), r9(F.max("value")).alias("most"))


_BY_TYPE = "SELECT event_type, count(*) AS n, round(max(value), 9) AS most FROM events GROUP BY event_type"


@query("SELECT DISTINCT user_id || '.wav' AS name, 44 + 2 * count(*) OVER (PARTITION BY user_id) AS bytes FROM events")
def s1_s5_s12_wav_folder(spark, sf):
    """Every file's series written as a WAV file into a folder that is then listed."""
    folder = recordings.work_path(spark, "wav").removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    wav = recordings.with_wav(series(spark, sf).withColumn("name", F.concat(F.col("file").cast("string"), F.lit(".wav"))), "values", 250)
    errors = recordings.write_files(wav, folder).where("error is not null").limit(1).collect()
    if errors:
        raise OSError(errors[0]["error"])
    return recordings.scan(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


@query(_BY_TYPE)
def s6_s7_s8_stage(spark, sf):
    """A stage made once; the second call reads what the first one wrote."""
    path = recordings.work_path(spark, "stage")
    recordings.stage(spark, path, lambda: by_type(spark, sf))
    return recordings.stage(spark, path, lambda: by_type(spark, sf).limit(0))


@query("SELECT event_id, event_type, value FROM events")
def s9_tab_delimited(spark, sf):
    path = recordings.work_path(spark, "tab")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.option("sep", "\t").option("header", True).csv(path)
    return recordings.tab_delimited(spark, path, ["event_id", "value"], "event_id long, event_type string, value double")


@query(f"SELECT * FROM ({_BY_TYPE}) UNION ALL SELECT * FROM ({_BY_TYPE})")
def s10_append(spark, sf):
    path = recordings.work_path(spark, "report")
    for _ in range(2):
        recordings.append_report(by_type(spark, sf), path)
    return spark.read.parquet(path)


@query(_BY_TYPE)
def s11_export(spark, sf):
    path = recordings.work_path(spark, "csv")
    recordings.export_csv(by_type(spark, sf), path)
    return spark.read.option("header", True).schema("event_type string, n long, most double").csv(path)


@query("SELECT user_id::VARCHAR AS path, count(*) AS n FROM events WHERE user_id % 7 <> 0 GROUP BY user_id")
def s14_readable(spark, sf):
    """Every seventh file's header is cut short; such files are found and left out."""
    wav = recordings.with_wav(series(spark, sf).withColumn("path", F.col("file").cast("string")), "values", 250)
    broken = wav.withColumn("content", F.when(F.col("file") % 7 == 0, F.substring("content", 1, 30)).otherwise(F.col("content")))
    return recordings.readable(recordings.read(broken)).select("path", "n")
