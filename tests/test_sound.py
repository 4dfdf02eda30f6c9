"""Training sequences, pairs of features and masks, signal code on tables, and files: hand cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot.functions import arrays, dsp
from echolot.operators import synthesis
from echolot.plans import queries as plans
from echolot.sources import recordings

SF = "/root/testdata/sf0.001"


def beds(spark, n=6):
    rng = np.random.default_rng(0)
    rows = [(k, [rng.normal(size=40).tolist(), rng.normal(size=30).tolist()], rng.normal(0, 0.1, 1500).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (90, [], [0.1]), (91, None, [0.1]), (92, [[1.0]], None)], "id long, calls array<array<double>>, noise array<double>")


def test_sequences_repeat_and_do_not_depend_on_partitions(spark):
    one = synthesis.bout_sequences(beds(spark).repartition(1), 250, 0.2, 0.05, (3.0, 9.0), False, 5).orderBy("id").collect()
    many = synthesis.bout_sequences(beds(spark).repartition(16), 250, 0.2, 0.05, (3.0, 9.0), False, 5).orderBy("id").collect()
    assert one == many and len(one) == 9
    assert [r["samples"] for r in one[-3:]] == [None] * 3
    other = synthesis.bout_sequences(beds(spark), 250, 0.2, 0.05, (3.0, 9.0), False, 6).orderBy("id").collect()
    assert other[0]["samples"] != one[0]["samples"]


def test_single_call_has_its_level():
    rng = np.random.default_rng(2)
    t = np.arange(500) / 250
    call, noise = np.sin(2 * np.pi * 30 * t), rng.normal(0, 0.2, 400)
    out, mask = synthesis.single_call(call, noise, 250, (20, 40), (6.0, 6.0), np.random.default_rng(3))
    assert len(out) == 1500 and mask.sum() == 500 and np.isclose(np.abs(out).max(), 0.99)
    bed = dsp.recycle(noise, 1500)
    scale = out[mask == 0] @ bed[mask == 0] / (bed[mask == 0] @ bed[mask == 0])
    assert np.allclose(out[mask == 0], scale * bed[mask == 0])
    added = dsp.band_pass((out / scale - bed)[mask == 1], 250, 20, 40)
    under = dsp.band_pass(bed[mask == 1], 250, 20, 40)
    assert np.isclose(10 * np.log10(np.mean(added**2) / np.mean(under**2)), 6, atol=1e-6)


def test_bouts_keep_their_bounds():
    kinds = set()
    for seed in range(300):
        rng = np.random.default_rng(seed)
        bouts = synthesis.bouts_of_one(1000, rng)
        kinds.add((len(bouts), bouts[0][0] == 0, bouts[-1][1] == 1000))
        assert all(0 <= a < b <= 1000 for a, b in bouts)
        for bout in bouts:
            starts = synthesis.starts_in_bout(bout, 40, 60, 10, rng)
            gaps = np.diff(starts) - 40
            assert starts and starts[0] >= bout[0] and all(a + 40 < bout[1] for a in starts[:-1]) and (gaps >= 50).all() and (gaps <= 70).all()
        many = synthesis.bouts_of_many(1000, rng)
        assert 2 <= len(many) <= 5 and many[0][0] == 0 and many[-1][1] == 1000
        assert all(a[1] > b[0] for a, b in zip(many, many[1:], strict=False))  # neighbours overlap
    assert kinds == {(1, True, True), (1, True, False), (1, False, True), (1, False, False), (2, True, True)}


def test_short_and_silent_inputs():
    rng = np.random.default_rng(1)
    out, mask = synthesis.bout_sequence([np.ones(50)], np.ones(20), 250, 0.1, 0.02, (0, 1), True, rng)
    assert not mask.any() and np.allclose(out, 0.99)  # the call does not fit
    out, mask = synthesis.single_call(np.zeros(5), np.zeros(7), 250, (10, 50), (0, 1), rng)
    assert not out.any() and mask.sum() == 5


def test_frame_pairs_and_lists(spark, tmp_path):
    x = [float(v) for v in range(7)]
    rows = spark.createDataFrame([("a", x, [0, 0, 1, 1, 0, 0, 1]), ("b", [2.0] * 4, [1] * 4), ("c", [], []), ("d", None, [1])], "split string, x array<double>, t array<int>")
    got = synthesis.frame_pairs(rows, 4, 2).orderBy("split", "part").collect()
    assert [(r["split"], r["part"], r["start"], r["t"]) for r in got] == [("a", 1, 1, [0, 0, 1, 1]), ("a", 2, 3, [1, 1, 0, 0]), ("b", 1, 1, [1] * 4)]
    want = (np.arange(4) - 1.5) / np.std(np.arange(4), ddof=1)
    assert np.allclose(got[0]["x"], want) and np.allclose(got[1]["x"], want) and got[2]["x"] == [0.0] * 4
    synthesis.export_pairs(synthesis.frame_pairs(rows, 4, 2), f"{tmp_path}/pairs")
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert back.where("split = 'a'").count() == 2 and back.count() == 3
    lists = spark.createDataFrame([(1, ["p", "q", "r"], [1, 2]), (2, [], [1]), (3, None, [1]), (4, ["s"], [5, 6])], "k int, x array<string>, t array<int>")
    got = synthesis.zip_lists(lists).orderBy("k", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, "p", 1), (1, 2, "q", 2), (4, 1, "s", 5)]


def test_mean_clip_duration(spark):
    rows = spark.createDataFrame([(k, 500, 250, k != 3) for k in range(1, 13)], "k int, n int, fs int, ok boolean")
    assert synthesis.mean_clip_duration(rows, "n", "fs", "ok", "k").first()[0] == pytest.approx((9 * 2 + 0.1) / 10)
    assert synthesis.mean_clip_duration(rows.where("k > 99"), "n", "fs", "ok", "k").first()[0] == 0.1


def test_calls_and_copies(spark):
    got = spark.range(1).select(synthesis.calls_per_sequence(F.lit(1800), F.lit(20.0), F.lit(30.0)), synthesis.copies_per_call(F.lit(16), F.lit(1200), F.lit(90)), synthesis.clean_samples_needed(F.lit(1201), F.lit(1800.0), F.lit(190.0), F.lit(10.0))).first()
    assert tuple(got) == (16, 300, 7800)  # (810 + 30) / 50; 19200 / 90 = 214; 1201 * 9 * .6 * 1.2 = 7782


def test_changes_against_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.repeat(rng.normal(0, 2, 3), 3) + rng.normal(0, 0.3, 9)
        cost = lambda cut: sum(((p - p.mean()) ** 2).sum() for p in np.split(x, cut)) + 0.7 * len(cut)
        cuts = [[i + 1 for i in range(8) if m >> i & 1] for m in range(256)]
        assert cost(dsp.mean_changes(x, 0.7)) == pytest.approx(min(map(cost, cuts)))


def test_lag_and_recycling(spark):
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=30).tolist(), rng.normal(size=20).tolist()) for _ in range(8)] + [(None, [1.0])]
    arrays.ship(spark)
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for r in df.select("a", "b", arrays.lag_of_best_match("a", "b").alias("lag"), arrays.recycle("a", 75).alias("long")).collect():
        if r["a"] is None:
            assert r["lag"] is None and r["long"] is None
            continue
        sums = {k: sum(r["a"][i + k] * r["b"][i] for i in range(20) if 0 <= i + k < 30) for k in range(-19, 30)}
        assert r["lag"] == max(sums, key=sums.get)
        assert r["long"] == r["a"] + r["a"][::-1] + r["a"][:15]


def test_files(spark, tmp_path):
    arrays.ship(spark)
    rows = spark.createDataFrame([("a.wav", [0.0, 0.5, -0.5]), ("no/b.wav", [0.1])], "name string, samples array<double>")
    got = {r["name"]: r["error"] for r in recordings.write_files(recordings.with_wav(rows, "samples", 250), str(tmp_path)).collect()}
    assert got["a.wav"] is None and "No such file" in got["no/b.wav"]
    path = recordings.only_match(spark, f"{tmp_path}/*.wav")
    assert path.endswith("/a.wav")
    files = recordings.scan(spark, str(tmp_path))
    assert recordings.read(files).select("samples").first()[0] == [0.0, 0.5, -0.5]
    h = recordings.headers(files).first()
    assert (h["fs"], h["channels"], h["width"], h["n"], h["bytes"]) == (250, 1, 2, 3, 50)
    (tmp_path / "c.wav").write_bytes(b"RIFF but no more")
    with pytest.raises(ValueError):
        recordings.only_match(spark, f"{tmp_path}/*.wav")
    assert {r["fail_comment"] for r in recordings.read(recordings.scan(spark, str(tmp_path))).collect()} == {None, "unreadable"}
    assert recordings.headers(recordings.scan(spark, str(tmp_path))).where("fs IS NULL").count() == 1


def test_tables_as_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("start\tkind\n1.5\ta\n2.5\tb\n")
    t = recordings.tab_delimited(spark, str(tmp_path / "t.txt"), ["start"], "start double, kind string")
    assert [tuple(r) for r in t.orderBy("start").collect()] == [(1.5, "a"), (2.5, "b")]
    with pytest.raises(ValueError, match="end"):
        recordings.tab_delimited(spark, str(tmp_path / "t.txt"), ["start", "end"], "start double, kind string")
    for _ in range(2):
        recordings.append_report(t, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 4
    recordings.export_csv(t, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["start", "kind"]


@pytest.mark.parametrize("name", ["w13_band_energy_minima", "w19_silence", "w22_changes", "x11_x12_mel_spectrum", "x13_x14_resample_filter", "g3_bouts_of_one", "g3_bouts_of_many"])
def test_queries_without_sql_cover_all_files(spark, name):
    got = plans.QUERIES[name](spark, SF)
    key = "id" if "id" in got.columns else "file"
    assert got.select(key).distinct().count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
