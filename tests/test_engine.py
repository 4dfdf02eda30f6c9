"""The engine's operators: every registered query against its SQL, hand cases, properties."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot.functions import dsp
from echolot.functions import scalars as S
from echolot.operators import framing, intervals, matching, metrics, sampling
from echolot.plans import queries as plans
from echolot.sources import recordings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and q is not None and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6)) for p, q in zip(x, y, strict=True)), (x, y)


def series(spark, values):
    return spark.createDataFrame([("f", k + 1, float(v)) for k, v in enumerate(values)], "file string, frame long, prob double")


def test_hysteresis_case(spark):
    got = intervals.hysteresis(series(spark, [0.1, 0.6, 0.3, 0.0, 0.3, 0.7]), 0.5, 0.2).orderBy("frame").collect()
    assert [r["active"] for r in got] == [False, True, True, False, False, True]
    with pytest.raises(ValueError):
        intervals.hysteresis(series(spark, [0.1]), 0.2, 0.5)


def test_hysteresis_equals_fold(spark):
    rng = np.random.default_rng(0)
    x = rng.random(400)
    on, want = False, []
    for v in x:
        on = v >= 0.7 or (on and v >= 0.4)
        want.append(bool(on))
    got = intervals.hysteresis(series(spark, x), 0.7, 0.4)
    assert [r["active"] for r in got.orderBy("frame").collect()] == want
    m = intervals.merge_regions(intervals.mask_to_regions(got), 3)
    again = intervals.merge_regions(m, 3)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))


def best_total(a, b, tol):
    best = 0

    def go(i, used, v):
        nonlocal best
        if i == len(a):
            best = max(best, v)
            return
        go(i + 1, used, v)
        for j, t in enumerate(b):
            if not used >> j & 1 and abs(a[i] - t) <= tol:
                go(i + 1, used | 1 << j, v + 2 * tol - abs(a[i] - t))

    go(0, 0, 0)
    return best


def test_alignment_is_optimal():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = (np.array(sorted(rnd.randint(0, 20) for _ in range(rnd.randint(0, 5))), np.int64) for _ in range(2))
        tol = rnd.randint(1, 6)
        p = matching.align(a, b, tol)
        assert len({i for i, _ in p}) == len(p) == len({j for _, j in p})
        assert sum(2 * tol - abs(int(a[i] - b[j])) for i, j in p) == best_total(a.tolist(), b.tolist(), tol)


def test_matching_is_not_of_largest_size(spark):
    us = lambda k: f"2024-01-01 00:00:0{k}"
    d = spark.createDataFrame([(k, us(k)) for k in (0, 1, 2)], "d_id long, d_time string").withColumn("d_time", plans.F.to_timestamp("d_time"))
    t = spark.createDataFrame([(k, us(k)) for k in (1, 2, 3)], "t_id long, t_time string").withColumn("t_time", plans.F.to_timestamp("t_time"))
    got = matching.match_events(d, t, 1_000_000).collect()
    assert sorted((r["d_id"], r["t_id"], r["gap_us"]) for r in got) == [(1, 1, 0), (2, 2, 0)]


def test_percentile_takes_midpoints(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    got = {r["level"]: r["percentile"] for r in metrics.midpoint_percentiles(df, "v", [1, 50, 99]).collect()}
    assert got == {1.0: 1.0, 50.0: 3.0, 99.0: 100.0}


def test_split_ratio(spark):
    df = spark.createDataFrame([("a", 1, 149), ("b", 1, 150), ("c", 1, 250)], "file string, first long, last long")
    got = intervals.split_long(df, 100.0).groupBy("file").count().collect()
    assert dict(map(tuple, got)) == {"a": 1, "b": 2, "c": 3}


def test_auc_equals_pairs(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (0.9, True)]
    df = spark.createDataFrame(rows, "s double, y boolean").withColumn("g", plans.F.lit(1))
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auc(df, "s", "y", ["g"]).first()["auc"], want)
    assert metrics.auc(df.where("y"), "s", "y", ["g"]).first()["auc"] == 1.0
    assert metrics.best_temperature(df.where("y"), "s", "y") is None


def whole_files():
    con = duckdb.connect()
    got = {}
    for file, value in con.sql(f"SELECT user_id, value FROM '{SF}/events.parquet' ORDER BY user_id, ts, event_id").fetchall():
        got.setdefault(file, []).append(value)
    assert max(map(len, got.values())) > 50
    return got


def test_recursive_mean_and_pcen_over_whole_files(spark):
    mean, pcen = {}, {}
    for file, values in whole_files().items():
        m = e = None
        for k, v in enumerate(values, 1):
            p = v / (v + 50.0)
            m, e = (p, v) if m is None else (0.9 * m + 0.1 * p, 0.975 * e + 0.025 * v)
            mean[file, k], pcen[file, k] = m, (v / (1e-6 + e) ** 0.98 + 2) ** 0.5 - 2**0.5
    got = {(r["file"], r["frame"]): r["m"] for r in plans.QUERIES["w26_recursive_mean"](spark, SF).collect()}
    assert got.keys() == mean.keys() and all(abs(got[k] - mean[k]) < 2e-9 for k in got)
    got = {(r["file"], r["frame"]): r["pcen"] for r in plans.QUERIES["w27_pcen"](spark, SF).collect()}
    assert got.keys() == pcen.keys() and all(abs(got[k] - pcen[k]) < 2e-7 for k in got)


def test_stitch_covers_whole_files(spark):
    want = {(file, k): v / (v + 50.0) for file, values in whole_files().items() for k, v in enumerate(values, 1)}
    got = {(r["file"], r["bin"]): r["value"] for r in plans.QUERIES["w18_stitch"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)


def test_flatten_takes_all_detections(spark):
    want = {}
    for file, values in whole_files().items():
        p = [v / (v + 50.0) for v in values]
        on, active = False, []
        for x in p:
            on = x >= 0.5 or (on and x >= 0.2)
            active.append(on)
        regions = []
        for k, x in enumerate(active, 1):
            if x and regions and k - regions[-1][1] <= 2:
                regions[-1][1] = k
            elif x:
                regions.append([k, k])
        want |= {(file, a, b): sum(p[a - 1 : b]) for a, b in regions if b > a}
    got = {(r["file"], r["first"], r["last"]): r["total"] for r in plans.QUERIES["w14_flatten"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)


def extreme_by_hand(values):
    d = 20 * np.log10(np.array(values) + 2.0**-52)
    c, var = d - d.mean(), d.var(ddof=1) if len(d) > 1 else 0.0
    low, q1, q3, high = np.percentile(d, [0.1, 25, 75, 99.9], method="hazen")
    m2 = (c**2).mean()
    skew, kurt = ((c**3).mean() / m2**1.5, (c**4).mean() / m2**2) if m2 else (0.0, 0.0)
    spread = (high - low) / (q3 - q1) if q3 > q1 else math.inf if high > low else 0.0
    return (0.35 * min(var / 15, 5) + 0.25 * max(0, (var**0.5 - 3) / 2) + 0.15 * max(0, (d.max() - d.min() - 25) / 15) + 0.1 * max(0, (skew - 1) / 3)
            + 0.1 * max(0, (kurt - 4) / 5) + 0.03 * max(0, (spread - 4) / 3) + 0.02 * abs(d.mean() - np.median(d)) / 2)


def test_extreme_score(spark):
    want = {file: extreme_by_hand(v) for file, v in whole_files().items()}
    got = {r["file"]: r for r in plans.QUERIES["a17_extreme_score"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[f]["score"] - want[f]) < 1e-6 and got[f]["extreme"] == (want[f] > 0.75) for f in want)
    hand = {"even": [1.0] * 20, "calm": [1.0, 1.1, 1.2, 1.0, 0.9, 1.05], "peak": [1.0] * 19 + [900.0], "one": [3.0]}
    df = spark.createDataFrame([(f, x) for f, v in hand.items() for x in v], "file string, x double")
    got = {r["file"]: r for r in metrics.extreme_score(df, "x", ["file"]).collect()}
    for f, v in hand.items():
        w = extreme_by_hand(v)
        assert got[f]["score"] == w or abs(got[f]["score"] - w) < 1e-6, f
        assert got[f]["extreme"] == (f == "peak")


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("20240115_123456.wav", "H08S1_151231-200000.wav", "2024-01-15_12-34-56.wav", "noise.wav")], "n string")
    got = [r[0] for r in df.select(S.micros(S.time_from_name(S.file_stem(plans.F.col("n"))))).collect()]
    assert [x is None for x in got] == [False, False, False, True]


def test_valid_signal(spark):
    cases = [[], [1.0, float("nan")], [1.0, float("inf")], [0.0, 0.0], [1e-39, 0.0], [2.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(c,) for c in cases], "x array<double>")
    assert [r[0] for r in df.select(S.valid_signal(plans.F.col("x"))).collect()] == [False] * 6 + [True]


def test_remainder_frame(spark):
    df = spark.createDataFrame([(10,), (11,)], "n int")
    starts = [r[0] for r in df.select(framing.frame_starts(plans.F.col("n"), 4, 2, True)).collect()]
    assert starts == [[1, 3, 5, 7], [1, 3, 5, 7, 9]]
    other = [r[0] for r in df.select(framing.frame_starts(plans.F.col("n"), 4, 2, True, False)).collect()]
    assert other[1][-1] == 11


def test_recordings_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1000) / 10) * 0.5
    (tmp_path / "a.wav").write_bytes(recordings.to_wav(x, 250))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"][-5:]: r for r in recordings.read(recordings.scan(spark, str(tmp_path))).collect()}
    assert got["a.wav"]["fs"] == 250 and np.allclose(got["a.wav"]["samples"], x, atol=1e-4)
    assert got["b.wav"]["fail_comment"] == "unreadable" and got["b.wav"]["samples"] is None


def test_stage_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert recordings.stage(spark, str(tmp_path / "s"), make).count() == 3
    assert len(made) == 1


def test_signals():
    rng = np.random.default_rng(1)
    t = np.arange(5000) / 250
    tone = np.sin(2 * np.pi * 20 * t)
    p = dsp.stft_power(tone, 212, 12)
    assert abs(int(p.mean(0).argmax()) * 250 / (2 * (p.shape[1] - 1)) - 20) < 0.5
    assert dsp.mel_spectrum(tone, 250, 212, 12, 10, 50).shape == (p.shape[0], 40)
    assert np.allclose(dsp.resample(tone, 250, 125)[200:-200], tone[::2][200:-200], atol=0.02)
    both = tone + np.sin(2 * np.pi * 90 * t)
    assert np.allclose(dsp.band_pass(both, 250, None, 50)[500:-500], tone[500:-500], atol=0.05)
    x = rng.normal(size=5000)
    x[1000:2000] = 1e-6
    m = dsp.silent_mask(x, 250, 1.0)
    assert m[1050:1950].all() and not m[:900].any() and dsp.silent_mask(np.zeros(100), 250, 0.1).all()
    steps = np.concatenate([rng.normal(0, 0.1, 100), rng.normal(3, 0.1, 80), rng.normal(1, 0.1, 60)])
    assert dsp.mean_changes(steps, 2.0) == [100, 180]
    assert dsp.split_points(np.array([1, 0.2, 1, 0.1, 1, 0.3, 1]), 3) == [1, 5] or len(dsp.split_points(np.array([1, 0.2, 1, 0.1, 1, 0.3, 1]), 3)) == 2
    assert dsp.lag_of_best_match(np.r_[np.zeros(7), tone[:100]], tone[:100]) == 7
    seq, mask = dsp.call_sequence([tone[:200], tone[:100]], rng.normal(size=2000), 250, 0.5, (5, 10), 3)
    assert mask.sum() == 300 and np.abs(seq).max() == 1


def test_strata_edges(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, float("nan"))], "id long, v double")
    got = {r["id"]: r["bin"] for r in sampling.equal_width_bins(df, "v", 4, "bin").collect()}
    assert got[3] == got[4] == 5 and got[1] == got[2] == 3


def test_streaming_sessions_equal_merging(spark, tmp_path):
    from echolot.streaming import sessions

    df = spark.createDataFrame([("f", f"2024-01-01 00:00:{s:02d}") for s in (1, 3, 20, 22, 50)], "file string, ts string").withColumn("ts", plans.F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.merged_events(stream, "5 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 2, 2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_time_from_name_by_hand(spark):
    """Each style of name, a failing first catch, and names without a time."""
    given = ["20240115_123456", "H08S1_151231-200000", "2024-01-15_12-34-56", "2024-01-15-12:34:56", "20240115-12:34:56", "7_2024-01-15_12-34-56", "noise", "x_2024-01-15_12-34-56", "20241399_123456", "a20240115-123456b"]
    got = [str(r[0]) for r in spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").orderBy("k").select(S.time_from_name(F.col("x"))).collect()]
    day = "2024-01-15 12:34:56"
    assert got == [day, "2015-12-31 20:00:00", day, day, day, day, "None", "None", "None", day]


def test_silence_by_hand():
    """Silence at the start and the end, half and twice the least length, constant, zero and all below."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 20000)  # silence is the lesser part: the median lies outside
    for a, n in ((0, 1000), (8000, 125), (18500, 1500)):
        x[a : a + n] *= 1e-9
    m = dsp.silent_mask(x, 250, 1.0)
    assert m[:990].all() and not m[1010:18490].any() and m[18510:].all()
    assert not dsp.silent_mask(np.full(3000, 1e-9), 250, 0.1).any() and dsp.silent_mask(np.zeros(3000), 250, 0.1).all()
    y = rng.normal(0, 1, 5000)
    y[1000:2000] = 0
    y[3000:3010] = 0
    m = dsp.silent_mask(y, 250, 1.0)
    assert m[1005:1995].all() and not m[2995:3015].any() and not m[:990].any()


def test_confidence_with_nan_and_null(spark):
    nan = float("nan")
    f = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.5, nan, 0.25, None, 0.75, 1.0], 1)], "file string, frame long, prob double")
    r = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 3, 5), ("a", 4, 4), ("a", 5, 6)], "file string, first long, last long")
    got = {(x["first"], x["last"]): x["confidence"] for x in intervals.confidence(r, f).collect()}
    assert got[1, 1] == 0.5 and np.isnan(got[1, 2]) and got[3, 5] == 0.5 and got[4, 4] is None and got[5, 6] == 0.875


def test_training_health_of_short_logs(spark):
    log = spark.createDataFrame([(1, float(k), v, v + 0.5) for k, v in enumerate([3.0, 2.0, 1.0])] + [(2, float(k), 1.0 / (k + 1), 0.2 * k) for k in range(30)], "run int, k double, train double, val double")
    over = {r["run"]: r for r in metrics.overfitting(log, "train", "val", "k", ["run"]).collect()}
    assert (over[1]["overfitting"], over[1]["severity"], over[1]["final_gap"]) == (False, None, None)
    assert (over[2]["overfitting"], over[2]["severity"]) == (True, "Severe")
    plateau = {r["run"]: (r["plateau"], r["premature"]) for r in metrics.convergence(log, "train", "k", ["run"]).collect()}
    assert plateau[1] == (3, False) and plateau[2][0] == 30
    loss = {r["run"]: r for r in metrics.loss_analysis(log, "train", "k", ["run"]).collect()}
    assert loss[1]["turn_ratio"] == 0 and loss[1]["converged"] is False and abs(loss[1]["reduction_pct"] - 200 / 3) < 1e-9


def test_slices_of_time_change_no_match_and_no_as_of(spark):
    from echolot.operators import matching

    rng = np.random.default_rng(5)
    def points(n, kind):
        return spark.createDataFrame([(int(k % 3), k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s))) for k, s in enumerate(rng.choice(4000, n, False))], f"site long, {kind}_id long, {kind}_time timestamp")
    d, t = points(300, "d"), points(260, "t")
    for by in ([], ["site"]):
        want = sorted(matching.match_events(d, t, 5_000_000, by).collect())
        assert want
        for width in (1_000_000, 30_000_000, 10**12):  # slices without points, components over many slices, one slice
            assert sorted(matching.match_events(d, t, 5_000_000, by, slice_us=width).collect()) == want
        for f in (matching.as_of, matching.as_of_within):
            want = sorted(f(t, d, by, "t_time", "d_time", "d_id").select("t_id", "found").collect(), key=repr)
            assert any(r["found"] is not None for r in want)
            for width in (1_000_000, 30_000_000, 10**12):
                assert sorted(f(t, d, by, "t_time", "d_time", "d_id", slice_us=width).select("t_id", "found").collect(), key=repr) == want


def test_as_of_in_slices_with_null_times_and_values(spark):
    from echolot.operators import matching

    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(k, at(s)) for k, s in enumerate((None, 0, 5, 95, 200))], "id long, t timestamp")
    right = spark.createDataFrame([(at(1), 10), (at(50), None), (at(90), 11), (at(90), 12)], "u timestamp, v long")
    for width in (None, 10_000_000):
        got = {r["id"]: r["found"] for r in matching.as_of(left, right, [], "t", "u", "v", slice_us=width).collect()}
        assert got == {0: None, 1: None, 2: 10, 3: 12, 4: 12}
    assert matching.as_of(left.limit(0), right.limit(0), [], "t", "u", "v", slice_us=1).collect() == []


def test_extreme_score_of_an_array_equals_that_of_rows(spark):
    rng = np.random.default_rng(3)
    for x in (rng.random(400), np.r_[rng.random(300) * 1e-4, rng.random(20)], np.ones(5)):
        df = spark.createDataFrame([(1, float(v)) for v in x], "file long, value double")
        assert abs(metrics.extreme_score(df, "value", ["file"]).first()["score"] - dsp.extreme_score(x)) < 1e-6


def test_event_segments():
    rng = np.random.default_rng(4)
    x = rng.normal(size=6000) * 1e-3
    x[2000:4000] += 3 * rng.normal(size=2000)
    got = dsp.event_segments(x, 50, 1, 2)
    assert [a for a, _ in got][0] == 1 and got[-1][1] == len(x) - 1
    for edge in (2000, 4000):
        assert any(abs(a - edge) <= 60 for a, _ in got)
    assert all(b == min(c - 1 + 100, len(x)) for (_, b), (c, _) in zip(got, got[1:], strict=False))
    assert dsp.event_segments(rng.normal(size=6000), 50, 1, 2) == [(1, 6000)]
    assert dsp.event_segments(np.zeros(10), 50, 1, 2) == [(1, 10)] and dsp.event_segments(np.zeros(0), 50, 1, 2) == [(1, 0)]
    assert dsp.moving_mean(np.arange(4.0), 2).tolist() == [0, 0.5, 1.5, 2.5]


def test_overlap_segments(spark):
    changes = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (1, 40), (2, 3)], "file long, place long")
    lengths = spark.createDataFrame([(1, 10), (2, 1), (3, 4)], "file long, n long")
    got = sorted(map(tuple, intervals.overlap_segments(changes, lengths, ["file"], "place", "n", 3).collect()))
    assert got == [(1, 1, 7), (1, 5, 10), (1, 9, 9), (3, 1, 3)]
