"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot.llm import chat, exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, warc
from echolot.llm.common import ASCII_LOWER, WS, components

SF = "/root/testdata/sf0.001"
RUN = re.compile("[\x20\x09-\x0d]+")
WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A line that many of the documents here share, word for word."
PASSAGE = " ".join(f"word{i}" for i in range(300))


def odd_rows():
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "x", "en", "b", 1), (5, "É é ß İ", "fr", "b", 5),
        (6, PASSAGE, "en", "a", 1), (7, PASSAGE + " tail", "en", "a", 1), (8, "head " + PASSAGE, "en", None, 1), (9, PASSAGE.upper(), "en", None, 1),
        (10, "same  text\nhere", "en", "a", 1), (11, "same text here", "en", "b", 1), (11, "same text here", "en", "b", 1), (None, "same text here", None, "b", None), (None, None, None, None, None),
        (12, ("spam " * 40).strip(), "en", "c", 1), (13, "a b c d e f g h i j k l\n" * 3, "en", "c", 1), (14, "MIT\nLicense and the GNU General Public License.", "en", "c", 1),
        (15, "Released under the MIT License.", "en", "c", 1), (16, "one\n\ntwo\n", "en", "c", 1), (17, "w " * 9000, "en", "c", 1), (18, "|x| " * 30 + " \x85", "en", "c", 1),
    ]
    rows += [(20 + k, f"{k} first\n  {LINE.upper() if k % 2 else LINE}\t\nlast {k}\n{LINE}", "en", "d", 1) for k in range(7)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clash(odd):
    """The same with columns whose names the operators use inside."""
    return odd.select("*", *[F.lit("x").alias(c) for c in ("uid", "size", "key", "keep_id", "n", "sha", "piece", "length", "root", "kept", "target", "_id", "drop")])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def norm(text):
    return RUN.sub(" ", text or "")


def both(docs, odd):
    return [(d, [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]) for d in (docs, odd)]


def test_line_dedup(docs, odd, clash, spark):
    for df, given in both(docs, odd):
        key = lambda x: x.strip(WS).translate(ASCII_LOWER)
        where = defaultdict(set)
        for i, t in given:
            for x in (t or "").split("\n"):
                where[key(x)].add(-1 if i is None else i)
        gone = {k: max(v) for k, v in where.items() if len(k) >= 40 and len(v) >= 5}
        want = []
        for i, t in given:
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in gone or (-1 if i is None else i) == gone[key(x)]]
            want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        got = rows(line_dedup.dedup_lines_digests(df), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert got == sorted(want, key=repr)
    assert any(n for _, _, n, _ in got)
    assert rows(line_dedup.dedup_lines_digests(clash), "doc_id", "n_lines", "n_dropped", "kept_sha256") == got
    # a filter far too small only makes more suspects
    assert rows(line_dedup.dedup_lines(odd, bits_per_line=1, max_filter_bytes=2**10), "doc_id", "n_lines", "n_dropped") == sorted((r[:3] for r in got), key=repr)
    assert line_dedup.dedup_lines_digests(odd.limit(0)).collect() == []


def test_line_dedup_in_shards_and_turns(odd):
    want = rows(line_dedup.dedup_lines(odd), "doc_id", "kept_text", "n_lines", "n_dropped")
    for how in ({"max_filter_bytes": 2**6, "turn_bytes": 2**7}, {"max_filter_bytes": 2**6, "turn_bytes": 2**6, "bits_per_line": 64}):
        assert rows(line_dedup.dedup_lines(odd, **how), "doc_id", "kept_text", "n_lines", "n_dropped") == want


def test_tasks_without_rows_or_hits(spark):
    """Tables without repeats, templates or calls, in more partitions than rows."""
    texts = [f"line {k} of a text that no other document holds, not even in part" for k in range(12)]
    df = spark.createDataFrame([(k, x, "en", "a", 1) for k, x in enumerate(texts)], DOCS).repartition(20)
    assert rows(line_dedup.dedup_lines(df), "doc_id", "kept_text", "n_dropped") == sorted(((k, x, 0) for k, x in enumerate(texts)), key=repr)
    assert rows(license_scan.scanned(df), "doc_id", "labels") == sorted(((k, "") for k in range(12)), key=repr)
    one = df.where("doc_id = 3")
    assert rows(line_dedup.dedup_lines(one), "doc_id", "n_lines") == [(3, 1)]
    assert rows(license_scan.scanned(one), "doc_id", "n_base") == [(3, 0)]
    assert rows(ngram_join.ngram_components(df, width=3, num=90, den=100), "doc_id", "component_id") == sorted(((k, k) for k in range(12)), key=repr)
    assert len(packing.best_fit(df).collect()) == 12


def test_hot_groups_meet_joins_that_split(spark):
    """With low thresholds adaptive execution splits the join at which a hot group meets its verdict."""
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("a passage that half of all documents hold, to the last character of it")).otherwise(F.concat(F.lit("other text that stands alone "), "id")), F.lit(" " * 200)).alias("text")).repartition(8)
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
           "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        rows_ = hot.select("doc_id", F.substring("text", 1, 64).alias("digit"))
        from echolot.llm.common import materialize

        groups = materialize(rows_.groupBy("digit").count().where("count > 1"), "test-groups")
        met = rows_.join(groups, "digit")
        assert len(met.collect()) == 2000
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
        got = exact_dedup.exact_dedup(hot).where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.max("group_size")).first()
        assert tuple(got) == (2000, 0, 2000)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_exact_dedup(docs, odd, clash):
    for df, given in both(docs, odd):
        groups = defaultdict(list)
        for i, t in given:
            groups[norm(t)].append(i)
        want = []
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            first = min(known, default=None)
            stay = [True] + [False] * (len(ids) - 1)
            want += [(i, first, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(sorted(ids, key=lambda x: (x is None, x)), stay, strict=True)]
        got = rows(exact_dedup.exact_dedup_digests(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert got == sorted(want, key=repr)
    assert rows(exact_dedup.exact_dedup_digests(clash), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == got
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and Counter(norm(r["text"]) for r in left.collect()).most_common(1)[0][1] == 1
    assert exact_dedup.exact_dedup_digests(odd.limit(0)).collect() == []


def test_exact_dedup_moves_few_unique_texts(spark):
    """Texts that stand alone don't shuffle, those with a common start neither, whatever the limit for broadcasts is."""
    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    start = "a start of more than sixty-four bytes that every third text begins with, "
    texts = [(start if k % 3 == 0 else "") + "".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest() for j in range(40)) + "x" * (k % 250) for k in range(1000)]
    texts += texts[:20]
    df = spark.createDataFrame([(k, x, "en", "a", 1) for k, x in enumerate(texts)], DOCS)
    limit, shuffled = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    try:
        for at in ("-1", limit):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
            before = moved()
            got = exact_dedup.exact_dedup_digests(df)
            shuffled.append((moved() - before) / sum(map(len, texts)))
            assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == {k: (k % 1000, 2 if k % 1000 < 20 else 1) for k in range(1020)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert max(shuffled) < 0.5 and max(shuffled) < 1.2 * min(shuffled), shuffled


@pytest.mark.parametrize("most_blocks", [1, 2**20])
def test_exact_dedup_filter_misses_no_group(spark, most_blocks):
    keyed = spark.range(4000).selectExpr("id", "id % 3000 AS gid", "cast(concat('digit ', id % 3000) AS binary) AS digit")
    groups = keyed.groupBy("gid", "digit").count().where("count > 1")
    left = [r["id"] for r in exact_dedup.having_groups(keyed, groups, ["gid", "digit"], most_blocks).collect()]
    assert len(left) == len(set(left)) and set(left) >= {k for k in range(4000) if k % 3000 < 1000}
    assert most_blocks == 1 or len(left) < 2200


def test_packing(docs, odd, clash):
    enc = packing.encoder("word_bpe_49k.json")
    for df, given in both(docs, odd):
        want = []
        for i, t in given:
            ids = [*enc.plain(t or ""), 1]
            for k in range(0, len(ids), 4096):
                x = np.array(ids[k : k + 4096], "<u4")
                want.append((i, k // 4096, k, len(x), zlib.crc32(x.tobytes())))
        got = packing.best_fit(df).collect()
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
        held = defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        room = []
        for n in sorted((w[3] for w in want), reverse=True):
            fit = min((x for x in room if x >= n), default=None)
            if fit is None:
                fit = 4096
            else:
                room.remove(fit)
            room.append(fit - n)
        assert len(held) <= len(room)
    assert len(packing.best_fit(clash).collect()) == len(got)
    assert packing.best_fit(odd.limit(0)).collect() == []
    whole = packing.sequences(odd).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(w[3] for w in want)


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "end", "of.", "É", "e\u0301", " ", "\n", "\u00a0", "\x01", ",", "'s", "12"]
    rng = np.random.default_rng(4)
    given = [(0, "end <|endoftext|> of"), *((k, "".join(parts[i] for i in rng.integers(0, len(parts), 12))) for k in range(1, 400))]
    want = []
    for i, t in given:
        x = np.array([*fresh.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(x), zlib.crc32(x.tobytes())))
    assert fresh.encode(given[0][1], add_special_tokens=False).ids == [806, 49407, 539]
    assert rows(packing.best_fit(spark.createDataFrame(given, "doc_id long, text string")), "doc_id", "length", "ids_crc32") == sorted(want, key=repr)


def test_ranked_in_small_buckets(spark):
    pieces = spark.range(1000).select((F.col("id") % 7 + 1).alias("length"), F.col("id").alias("doc_id"), F.lit(0).alias("piece"))
    got = packing.ranked(pieces, "length", [F.col("doc_id")], [F.col("doc_id")], 10).collect()
    by = defaultdict(list)
    for r in got:
        by[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def links(given, width, num, den):
    sets = []
    for _, t in given:
        w = WORDS.findall((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(given)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(given):
        low[root(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in low[root(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _) in enumerate(given)), key=repr)


@pytest.mark.parametrize("width,num,slices", [(3, 90, 1), (5, 80, 2)])
def test_ngram_join(spark, odd, clash, width, num, slices, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df, given in both(docs, odd):
        got = rows(ngram_join.ngram_components(df, width, num, 100, slices), "doc_id", "n_shingles", "component_id")
        assert got == links(given, width, num, 100)
    assert rows(ngram_join.ngram_components(clash, width, num, 100), "doc_id", "n_shingles", "component_id") == got
    assert ngram_join.ngram_components(odd.limit(0)).collect() == []


def test_ngram_join_with_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rng = np.random.default_rng(3)
    given = []
    for k in range(240):
        w = [f"t{i}" for i in range(60 if k % 3 else 66)]
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = f"u{rng.integers(0, 40)}"
        given.append((k, " ".join(w)))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    for width, num in ((1, 90), (3, 80)):
        assert rows(ngram_join.ngram_components(df, width, num, 100), "doc_id", "n_shingles", "component_id") == links(given, width, num, 100)


def test_ngram_join_with_small_leaves_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    long = [f"t{i}" for i in range(21_000)]
    given = []
    for k in range(12):
        w = list(long)
        w[:50] = [f"u{k}x{i}" for i in range(50)]
        given.append((k, " ".join(w)))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    for num in (90, 80):
        got = rows(ngram_join.ngram_components(df, 1, num, 100), "doc_id", "n_shingles", "component_id")
        assert got == sorted([(k, 21_000, 0) for k in range(12)], key=repr)


def test_ngram_join_in_deep_trees(spark, monkeypatch):
    """Many levels, several components in a family, and pairs of leaves that only the second meeting connects."""
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "FAN", 1)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = np.random.default_rng(8)
    given = []
    for k in range(150):
        w = [f"t{i}" for i in range(40 + k % 9)]
        for at in rng.integers(0, len(w), rng.integers(0, 4)):
            w[at] = f"u{rng.integers(0, 12)}"
        given.append((k, " ".join(w)))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    assert rows(ngram_join.ngram_components(df, 1, 90, 100), "doc_id", "n_shingles", "component_id") == links(given, 1, 90, 100)


def test_one_of_each_goes_by_rows(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    given = [(1, a, "x"), (2, a + " more", "x"), (2, b, "x"), (2, b, "y"), (None, b + " more", "x"), (None, "other words here", "x"), (3, None, "x"), (3, None, "x"), (4, "", "z")]
    df = spark.createDataFrame(given, "doc_id long, text string, part string").repartition(3)
    got = ngram_join.one_of_each(df, width=2)
    assert got.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert left == sorted([(1, a), (2, b), (None, "other words here"), (3, None), (3, None), (4, "")], key=repr)
    assert ngram_join.one_of_each(df.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2100)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_quality_rules(odd, clash, docs):
    for df, given in both(docs, odd):
        want = []
        for i, t in given:
            t = t or ""
            w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
            grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            n = Counter(grams)
            hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
            failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
            want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed))
        got = quality_rules.judged(df)
        assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
        assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    assert len(quality_rules.judged(clash).collect()) == len(want)
    assert quality_rules.judged(odd.limit(0)).collect() == []


def test_quality_ablation(docs):
    book = quality_rules.ledger(docs).cache()
    bits = [r["fail_bits"] for r in book.collect()]
    m = quality_rules.mask("quality_v1")
    for r in quality_rules.ablation(book, "quality_v1").collect():
        assert r["n_failing"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_failing_alone"] == sum(b & m == r["bit"] for b in bits)
        assert r["n_kept_without"] == sum(not b & m & ~r["bit"] for b in bits)


def test_quality_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    kept = dict(got)
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_mixing(odd, clash, docs):
    for df, given in both(docs, odd):
        sized = [(r["doc_id"], r["source"], len(WORDS.findall(r["text"] or ""))) for r in df.collect()]
        sums = Counter()
        for _, s, n in sized:
            sums[s] += n
        order = sorted(sums, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        target, fixed, left = {}, set(), 1.5 * sum(sums.values())
        while True:
            free = [s for s in order if s not in fixed]
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if target[s] > 2 * sums[s]]
            if not over:
                break
            for s in over:
                target[s] = 2.0 * sums[s]
                left -= target[s]
                fixed.add(s)
        got = mixing.mixed(df).collect()
        assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(sized, key=repr)
        taken = Counter()
        for r in got:
            assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sums[r["source"]]
            assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        for s in order:
            assert abs(target[s] - taken[s]) <= max((n for _, x, n in sized if x == s), default=0) / 2 + 1e-6
            gap = abs(target[s] - taken[s])  # no document that was left would have come nearer
            epochs = target[s] // max(sums[s], 1)
            assert all(abs(taken[s] + r["size"] - target[s]) >= gap - 1e-6 for r in got if r["source"] == s and r["copies"] == epochs)
        assert rows(mixing.mixed(df), "doc_id", "taken") == rows(mixing.mixed(df.repartition(5)), "doc_id", "taken")
        # buckets of a few rows give the same choice up to the border's refinements
        small = Counter()
        for r in mixing.mix(df, bucket_rows=2).collect():
            small[r["source"]] += r["taken"]
        assert all(abs(small[s] - target[s]) <= max((n for _, x, n in sized if x == s), default=0) / 2 + 1e-6 for s in order)
    assert rows(mixing.mixed(clash), "doc_id", "taken") == rows(mixing.mixed(odd), "doc_id", "taken")
    assert mixing.mixed(odd.limit(0)).collect() == []
    out = mixing.repeat_mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mixing.mixed(docs).collect())


def test_mixing_buckets_stay_small_whatever_the_weights(spark):
    """A source mostly of symbols, whose keys are larger than the others'."""
    texts = [("word " * 8) + "#$%& " * (8 if k % 10 else 0) for k in range(6000)]
    df = spark.createDataFrame([(k, x, "en", "a" if k % 3 else "b", 1) for k, x in enumerate(texts)], DOCS).repartition(4)
    left: list[str] = []
    out = mixing.mix(df, bucket_rows=100, left=left)
    taken = {r["source"]: (r["t"], r["target"]) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert all(abs(t - target) <= 8 for t, target in taken.values())
    cells = spark.read.parquet(*[x for x in left if "mix-cells" in x])
    rows_ = spark.read.parquet(*[x for x in left if x.rpartition("/")[2].startswith("mix-") and not any(k in x for k in ("mix-cells", "mix-plan"))])
    n = rows_.groupBy("source").count().withColumn("buckets", F.ceil(F.col("count") / 100))
    cell = F.floor(F.log2("key") * F.col("buckets"))
    met = rows_.join(n, "source").withColumn("c2", cell).join(cells.withColumnRenamed("s2", "source"), ["source", "c2"])
    assert met.groupBy("source", "bucket").count().agg(F.max("count")).first()[0] < 300


def test_quality_classifier(spark, odd, clash, labels):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.scored(docs, labels)
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert r > 0.98
    head = got.limit(50).collect()
    assert all(x["held_out"] == quality_classifier.held_out(x["doc_id"]) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in head)
    scored = rows(quality_classifier.scored(odd, labels), "doc_id", "held_out", "score")
    assert len(scored) == odd.count() and scored == rows(quality_classifier.scored(clash, labels), "doc_id", "held_out", "score")
    assert {x["score"] for x in quality_classifier.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.scored(odd.limit(0), labels).collect() == []
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns


def test_classifier_bounds_its_sample_and_keeps_columns(spark):
    good, bad = "A plain sentence of ordinary words stands here.", "$$$ || !!! ## $$"
    docs = [(k, "\n".join([good if k % 2 else bad] * (1 + k % 7)), 0.5 + k) for k in range(300)] + [(1, good, 9.0)] * 200 + [(900, None, 1.0), (901, good * 3000, 2.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality double").repartition(3)
    lab = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(901, 1)], "doc_id long, quality int")
    got = quality_classifier.keep_good(df, lab)
    assert got.columns == df.columns
    have = Counter((r["doc_id"], r["quality"]) for r in got.collect())
    assert have[(1, 9.0)] == 200 and all(have[(k, 0.5 + k)] == k % 2 for k in range(300)) and have[(901, 2.0)] == 1
    field = quality_classifier.learn(df, lab, fit_rows=40, fit_lines=3)
    again = quality_classifier.learn(df.repartition(7), lab, fit_rows=40, fit_lines=3)
    assert field.weights.tolist() == again.weights.tolist()


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 4, 3, 6)]
    marginals, counts = quality_classifier.forward_backward(chains, moves, True)
    want = np.zeros((2, 2))
    for c, m in zip(chains, marginals, strict=True):
        weights, good, pairs = 0.0, np.zeros(len(c)), np.zeros((2, 2))
        for code in range(2 ** len(c)):
            y = [code >> k & 1 for k in range(len(c))]
            w = math.exp(sum(e for e, v in zip(c, y, strict=True) if v) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weights += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        assert np.allclose(good / weights, m)
        want += pairs / weights
    assert np.allclose(counts, want)


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    back = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    given = [
        (1, 0, "user", "héllo \"x\"\n"), (1, 1, "assistant", call(("a", "search", {"query": "q", "limit": 2}), ("b", "fetch", {"url": {"$result": "a"}}))), (1, 3, "tool", back("b", [1, {"z": 1, "a": None}])), (1, 4, "tool", back("a", "r")),
        (1, 5, "assistant", call(("a", "search", {"query": "again"}))), (2, 0, "tool", back("lost", 1)), (2, 1, "assistant", call(("c", "search", {"limit": True}), ("d", "nothing", {}))),
        (3, 0, "assistant", call(("p", "calculate", {"expression": {"$result": "q"}}), ("q", "calculate", {"expression": {"$result": "p"}}))), (3, 1, "tool", back("p", 1)), (3, 2, "tool", back("q", 2)),
        (4, 0, None, None), (None, None, "user", "{broken"), (None, 1, "user", ""), (4, 1, "user", "x" * 100_000), (4, 1, "user", "same"), (4, 1, "user", "same"),
    ]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("uid", F.lit(1)).withColumn("status", F.lit("s"))
    got = chat.format_chat(df.repartition(3)).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in got if r["kind"] != "message"}
    status = {k: r["status"] for k, r in by.items()}
    assert status[1, "call", "a", 1] == status[1, "result", "a", 4] == status[1, "call", "b", 1] == status[1, "result", "b", 3] == "linked"
    assert status[1, "call", "a", 5] == "repeated" and status[2, "result", "lost", 0] == "no_call" and status[2, "call", "c", 1] == "no_result"
    assert {status[3, k, x, t] for k, x, t in (("call", "p", 0), ("call", "q", 0), ("result", "p", 1), ("result", "q", 2))} == {"cycle"}
    assert by[1, "call", "a", 1]["valid"] and by[1, "call", "b", 1]["valid"] and by[2, "call", "c", 1]["valid"] is False and by[2, "call", "d", 1]["valid"] is False
    place = lambda r: (r["at_turn"], r["depth"], r["turn"], r["seq"])
    chain = [by[1, "call", "a", 1], by[1, "result", "a", 4], by[1, "call", "b", 1], by[1, "result", "b", 3]]
    assert sorted(chain, key=place) == chain
    assert by[1, "result", "b", 3]["json"] == '{"content":[1,{"a":null,"z":1}],"role":"tool","tool_call_id":"b"}'
    plain = sorted(((r["conv_id"], r["turn"], json.loads(r["json"])["content"]) for r in got if r["kind"] == "message"), key=repr)
    assert plain == sorted(((c, t, x) for c, t, _, x in given if x is None or not x.startswith("{") or x == "{broken"), key=repr)
    assert chat.format_chat(df.limit(0)).collect() == []


def test_chat_takes_any_text(spark):
    deep = '{"tool_calls": [{"id": "d", "name": "search", "arguments": ' + "[" * 3000 + "]" * 3000 + "}]}"
    given = [
        (1, 1, "assistant", r'{"tool_calls": [{"id": "\ud800", "name": "search", "arguments": {"query": "\udfff x"}}]}'), (1, 2, "tool", r'{"tool_call_id": "\ud800", "content": 1}'),
        (2, 1, "assistant", deep), (3, 1, "assistant", '{"tool_calls": [{"id": "n", "name": "search", "arguments": {"query": NaN}}]}'),
        (4, 1, "assistant", '{"tool_calls": [{"id": "i", "name": "pick", "arguments": {"n": 1e999}}]}'), (5, 1, "assistant", '{"tool_calls": [{"id": "t", "name": "pick", "arguments": {"n": null}}]}'),
        (6, 1, "assistant", '{"tool_calls": [{"id": "t", "name": "pick", "arguments": {"n": true}}]}'), (7, 1, "user", "x" * 300_000), (8, None, None, None)]
    tools = chat.TOOLS | {"pick": {"type": "object", "properties": {"n": {"type": ["integer", "null"], "enum": [1, None]}}}}
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"), tools).orderBy("turn").collect()}
    assert [got[k]["kind"] for k in range(1, 9)] == ["result", "message", "message", "message", "call", "call", "message", "message"]
    assert got[1]["status"] == "linked" and got[1]["call_id"] == "\\ud800" and json.loads(got[1]["json"])["content"] == 1
    assert got[5]["valid"] is True and got[6]["valid"] is False
    assert all(json.loads(r["json"], parse_constant=lambda x: pytest.fail(x)) for r in got.values())


def test_chat_against_brute_force(spark):
    """Random conversations with repeated identifiers, missing ends, forward references and cycles."""
    import random

    rng = random.Random(5)
    given = []
    for conv in range(40):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += 1
            ids = [f"c{rng.randint(0, 5)}" for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.55:
                calls = [{"id": i, "name": "search", "arguments": {"query": {"$result": f"c{rng.randint(0, 5)}"} if rng.random() < 0.5 else "q"}} for i in ids]
                given.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            else:
                given.append((conv, turn, "tool", json.dumps({"tool_call_id": ids[0], "content": turn})))
    want = []
    for conv in range(40):
        nodes = []
        for c, turn, role, text in given:
            if c == conv:
                for seq, kind, call_id, _, _, needs, js in chat.nodes_of(role, text, chat.TOOLS):
                    nodes.append({"turn": turn, "seq": seq, "kind": kind, "id": call_id, "needs": needs, "json": js})
        nodes.sort(key=lambda n: (n["turn"], n["seq"]))
        first = {}
        for n in nodes:
            n["again"] = (n["kind"], n["id"]) in first
            first.setdefault((n["kind"], n["id"]), n)
        for n in nodes:
            after = [first[("result", x)] for x in n["needs"] if ("result", x) in first]
            if n["kind"] == "result" and not n["again"] and ("call", n["id"]) in first:
                after.append(first[("call", n["id"])])
            n["after"] = after

        def place(n, path):
            if any(n is p for p in path):
                return None
            if "place" not in n:
                below = [place(b, [*path, n]) for b in n["after"]]
                if any(b is None for b in below):
                    return None
                top = max(below, default=(-1, 0))
                n["place"] = (n["turn"], 0) if top[0] < n["turn"] else (top[0], top[1] + 1)
            return n["place"]

        for n in nodes:
            at = place(n, [])
            peer = first.get(("result" if n["kind"] == "call" else "call", n["id"]))
            status = "repeated" if n["again"] else "cycle" if at is None else "linked" if peer else "no_result" if n["kind"] == "call" else "no_call"
            want.append((conv, n["turn"], n["seq"], n["kind"], n["id"], status, *(at or (n["turn"], 0))))
    got = rows(chat.format_chat(spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(3)), "conv_id", "turn", "seq", "kind", "call_id", "status", "at_turn", "depth")
    assert got == sorted(want, key=repr)
    assert {r[5] for r in got} == {"linked", "repeated", "cycle", "no_result", "no_call"}


def test_chat_orders_long_chains(spark):
    given, n = [], 54
    for k in range(n):
        args = {"expression": {"$result": f"c{k - 1}"}} if k else {"expression": "1"}
        given.append((1, n - k, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "calculate", "arguments": args}]})))
        given.append((1, n, "tool", json.dumps({"tool_call_id": f"c{k}", "content": k})))
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.format_chat(df).collect()
    assert {r["status"] for r in got} == {"linked"}
    got.sort(key=lambda r: (r["at_turn"], r["depth"], r["turn"], r["seq"]))
    assert [(r["kind"], r["call_id"]) for r in got] == [(kind, f"c{k}") for k in range(n) for kind in ("call", "result")]


def test_chat_serialises_all_turns(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = rows(chat.format_chat(df), "conv_id", "turn", "json")
    want = sorted(((r["conv_id"], r["turn"], json.dumps({"content": r["text"], "role": r["role"]}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))) for r in df.collect()), key=repr)
    assert got == want


def test_warc(spark, tmp_path):
    given = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "u\r\nX: y", ""), (4, None, None), (5, "http://b", "x" * 200_000), (5, "http://b", "x" * 200_000), (None, "http://c", "<p>é</p>"), (6, "http://d", "a\r\n\r\nb"), (None, "n", "alone")]
    df = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("sha", F.lit("s")).withColumn("payload", F.lit(0)).repartition(3)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_records(index, span_bytes=5000).collect()
    want = []
    for i, _, t in given:
        t = t or ""
        last = max((j for j, _, x in given if (x or "") == t and j is not None), default=None)
        kind = "revisit" if last is not None and (i is None or i < last) else "response"
        want.append((i, len(t.encode()), warc.digest(t.encode()), kind, last if kind == "revisit" else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)
    bodies = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert bodies[6] == b"a\r\n\r\nb" and bodies[2] == "<p>é</p>".encode() and len(bodies[5]) == 200_000
    some = warc.read_records(index.where("url = 'http://d'")).collect()
    assert [r["page_id"] for r in some] == [6]
    for name in {r["file"] for r in index.collect()}:  # any reader of gzip members can read an archive through
        data = open(name.removeprefix("file://"), "rb").read()
        assert zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_warc_headers_can_be_followed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", "<p>other</p>"), (None, "http://a/4", None)], "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    heads = []
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            assert warc.parse(_first_member(r["file"]))[0]["WARC-Type"] == "warcinfo"
            f.seek(r["offset"])
            heads.append(warc.parse(f.read(r["length"]))[0])
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    first = next(h for h in heads if h["WARC-Record-ID"] == revisit["WARC-Refers-To"])
    assert (first["WARC-Type"], first["WARC-Target-URI"], first["WARC-Date"]) == ("response", revisit["WARC-Refers-To-Target-URI"], revisit["WARC-Refers-To-Date"])
    assert first["WARC-Target-URI"] == "http://a/2" and len({h["WARC-Record-ID"] for h in heads}) == 4


def _first_member(file):
    with open(file.removeprefix("file://"), "rb") as f:
        raw = f.read()
    d = zlib.decompressobj(wbits=31)
    d.decompress(raw)
    return raw[: len(raw) - len(d.unused_data)]


def test_license_scan(odd, clash, docs):
    for df, given in both(docs, odd):
        want = []
        for i, t in given:
            w = license_scan.tokens(t or "")
            at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
            found = {label for label, x in license_scan.TEMPLATES for line in (t or "").split("\n") if 10 * len(set(license_scan.tokens(line)) & set(license_scan.tokens(x))) >= 8 * len(set(license_scan.tokens(x)))}
            base = {label for _, label in at}
            want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | found))))
        got = rows(license_scan.scanned(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
        assert got == sorted(want, key=repr)
    assert rows(license_scan.scanned(clash), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels") == got
    assert license_scan.scanned(odd.limit(0)).collect() == []


def test_license_scan_finds_wrapped_notices(spark):
    import textwrap

    given, want = [], []
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        for shift in (0, 20, 45):
            lines = textwrap.wrap("w" * shift + " " + text + " and so on", 72)
            given.append((len(given), "def f(x):\n\n" + "\n".join(f" * {x}" for x in lines) + "\n *\n * other words\n"))
            want.append((len(want), label))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, label in want:
        assert label in got[i]["labels"].split(","), given[i]
        assert any(b["label"] == label and b["containment"] == 1.0 for b in got[i]["blocks"]), given[i]
    apart = "Redistribution and use in source\n" + "more words " * 8 + "\nand binary forms, with or without\n" + "more words " * 8 + "\nmodification, are permitted"
    assert license_scan.scan(spark.createDataFrame([(1, apart)], "doc_id long, text string")).first()["labels"] == ""


def test_license_scan_finds_whole_licenses(spark):
    import textwrap

    whole = {label: text for label, text in license_scan.TEMPLATES if len(text) > 300}
    assert set(whole) == {"mit", "bsd", "isc", "zlib", "apache", "gpl"}
    given, want = [], []
    for label, text in sorted(whole.items()):
        words = text.split()
        for share in (1.0, 0.93, 0.4):  # the last two fifths of a license hold too few of its tokens
            part = " ".join(words[len(words) - int(share * len(words)):])
            given.append((len(given), "Copyright (c) 2020 A. Nobody\n\n" + "\n".join(f"# {x}" for x in textwrap.wrap(part, 60)) + "\nimport os"))
            want.append((label, share))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, (label, share) in enumerate(want):
        best = max((b["containment"] for b in got[i]["blocks"] if b["label"] == label), default=0.0)
        assert (best == 1.0) if share == 1.0 else (best >= 0.8) if share > 0.9 else label not in {b["label"] for b in got[i]["blocks"]} or label == "gpl", (label, share, best)


def test_pipeline(spark, labels):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = {name: f for name, f in corpus_pipeline.STAGES}
    good = step["quality_classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    once = step["exact_dedup"](spark, good, SF)
    want = {}
    for r in good.collect():
        want[norm(r["text"])] = min(r["doc_id"], want.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(want.values())
    far = step["ngram_jaccard_join"](spark, once, SF)
    given = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert sorted(r["doc_id"] for r in far.collect()) == sorted({c for _, _, c in links(given, 5, 80, 100)})
    mix = step["source_mixing"](spark, far, SF)
    assert mix.columns == docs.columns
    final = step["best_fit_packing"](spark, mix, SF)
    assert sum(r["piece"] == 0 for r in final.collect()) == mix.count()
    assert corpus_pipeline.run(spark, SF).count() == final.count()


def test_the_rest_stands_alone():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/echolot"):
        if not folder.endswith("/llm"):
            assert not [n for n in names if n.endswith(".py") and "llm" in open(f"{folder}/{n}").read()]
