"""Line deduplication by two Bloom filters.

Pass 1 hashes the distinct keys of each document and sets bits in a filter of hashes seen once; a hash that the first
filter already holds goes to a second filter, of hashes seen twice. Builders work on their own rows and are merged by
a tree: twice = twice or twice' or (once and once'), once = once or once'. Neither filter misses a repeat, so lines
that the second filter lacks occur in one document only and never leave their task. Pass 2 marks the rest, the
suspects, at their documents, and only they shuffle: documents are counted exactly by key text, false positives fall
out there, and the lines to drop go back to their documents. Documents without suspects take no part in any shuffle.

The filters are cut into shards by ranges of the hash. A shard has at most max_filter_bytes for each filter, and there are
as many shards as the number of lines asks for, so bits grow with the lines and the share of false suspects does not.
Shards are built and asked in turns of as many as turn_bytes allow, which bounds what a task holds and what is sent to
it; a corpus of one turn, some 60 million long lines by default, is read twice. Every further turn reads it once more,
so there are most_turns at most: beyond that many lines the bits a line get fewer, more lines become suspects and the
shuffle grows, but the result does not change. Hot keys: documents are counted by (key, document) first, so one key in
a third of all documents spreads over all tasks; the counted keys are written before suspects meet them, so adaptive
execution sends them along where they are few and splits hot keys elsewhere.

A null text is one empty line. Rows with one doc_id count as one document; a null doc_id counts as one document below
all others. Very long texts are handled whole, one at a time in each task. Empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, drop_paths, hide_null, materialize, mix64, ship, show_null, with_rows


_WS = WS.encode()


def line_key(line: bytes) -> bytes:
    """The key in UTF-8, where only A-Z have a lower case."""
    return line.strip(_WS).lower()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {k for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if len(line) >= min_chars and len(k := line_key(line)) >= min_chars}
    return {k for k in keys if k.isascii() or len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars}


class Filter:
    """A Bloom filter of 2**log2_bits bits and two probes, over 64-bit hashes."""

    def __init__(self, log2_bits: int, data: bytes | None = None):
        self.log2_bits = log2_bits
        self.bits = np.zeros(2**log2_bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _probes(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for x in (h, mix64(h)):
            at = x >> np.uint64(64 - self.log2_bits)
            out.append(((at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))))
        return out

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self._probes(h):
            np.bitwise_or.at(self.bits, byte, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self._probes(h)
        return ((self.bits[a] & x) != 0) & ((self.bits[b] & y) != 0)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash, from its lower half, and what the shard's filter goes by."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64), mix64(h)


def _builder(log2_bits: int, min_chars: int, shards: int, turn: range):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: dict[int, tuple[Filter, Filter]] = {}
        for pdf in batches:
            keys = [k for text in pdf["text"] for k in _keys(text, min_chars)]
            if not keys:
                continue
            h, n = np.unique(_hashes(keys), return_counts=True)
            shard, h = _shard(h, shards)
            for k in np.unique(shard).tolist():
                if k in turn:
                    once, twice = pairs.setdefault(k, (Filter(log2_bits), Filter(log2_bits)))
                    own, many = h[shard == k], n[shard == k] > 1
                    twice.add(own[many | once.has(own)])
                    once.add(own)
        for k, (once, twice) in pairs.items():
            yield pd.DataFrame({"shard": [k], "once": [zlib.compress(once.bits.tobytes(), 1)], "twice": [zlib.compress(twice.bits.tobytes(), 1)]})
    return build


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one shard stand together; two filters are held."""
    shard = once = twice = None
    done = lambda: pd.DataFrame({"shard": [shard], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})
    for pdf in batches:
        for k, a, b in zip(pdf["shard"].tolist(), pdf["once"], pdf["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if k != shard:
                if once is not None:
                    yield done()
                shard, once, twice = k, a, b
            else:
                once, twice = once | a, twice | b | (once & a)
    if once is not None:
        yield done()


_PAIR = "shard int, once binary, twice binary"


def twice_filters(docs: DataFrame, min_chars: int, log2_bits: int, shards: int, turn: range) -> dict[int, bytes]:
    """The filters of hashes seen twice, of the shards of this turn, compressed."""
    filters = docs.mapInPandas(with_rows(_builder(log2_bits, min_chars, shards, turn)), _PAIR)
    left = tasks = docs.select("doc_id").rdd.getNumPartitions()
    while left > 1:  # builders are merged sixteen at a time, each shard by itself
        left = math.ceil(left / 16)
        dealt = filters.withColumn("_t", F.pmod(F.spark_partition_id(), F.lit(left))) if left > 1 else filters.withColumn("_t", F.lit(0))
        filters = dealt.repartition(min(left * len(turn), tasks), "shard", "_t").sortWithinPartitions("shard", "_t").drop("_t").mapInPandas(with_rows(_merge), _PAIR)
    filters = filters.repartition(len(turn), "shard").sortWithinPartitions("shard").mapInPandas(with_rows(_merge), _PAIR)
    return {r["shard"]: bytes(r["twice"]) for r in filters.select("shard", "twice").collect()}  # at most turn_bytes


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_line: int = 16, max_filter_bytes: int = 2**25, turn_bytes: int = 2**27, most_turns: int = 4) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for each row of docs.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least min_chars code points
    in at least min_docs documents lose all their lines, save in the largest doc_id that holds them.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(hide_null("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    # lines long enough to have a key are at least min_chars long: no text holds more of them than its length allows
    n = docs.agg(F.sum(F.floor(F.length(text) / (min_chars + 1)) + 1)).first()[0] or 0
    step = max(1, turn_bytes // max_filter_bytes)
    shards = min(max(1, math.ceil(bits_per_line * n / (8 * max_filter_bytes))), step * most_turns)
    log2_bits = max(13, min(math.ceil(math.log2(bits_per_line * n / shards + 1)), int(math.log2(8 * max_filter_bytes))))
    marked, spent = docs.withColumn("suspects", F.array().cast("array<string>")), []
    for at in range(0, shards, step):
        turn = range(at, min(at + step, shards))
        sent = spark.sparkContext.broadcast(twice_filters(docs, min_chars, log2_bits, shards, turn))

        @F.pandas_udf("array<string>")
        def suspects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            filters = {k: Filter(log2_bits, zlib.decompress(x)) for k, x in sent.value.items()}
            for batch in texts:
                own = [list(_keys(x, min_chars)) for x in batch]
                keys = [k for x in own for k in x]
                shard, h = _shard(_hashes(keys), shards)
                hit = np.zeros(len(keys), bool)
                for k, f in filters.items():
                    mine = np.flatnonzero(shard == k)
                    hit[mine] = f.has(h[mine])
                hits, place, out = hit.tolist(), 0, []
                for x in own:
                    out.append([k.decode("utf-8", "surrogatepass") for k, yes in zip(x, hits[place : place + len(x)], strict=True) if yes])
                    place += len(x)
                yield pd.Series(out, dtype=object)

        before, spent = spent, []
        marked = materialize(marked.withColumn("suspects", F.concat("suspects", suspects("text"))), "line-suspects", spent)
        drop_paths(spark, before)
    found = marked.where(F.size("suspects") > 0).select("doc_id", F.explode("suspects").alias("key"))
    counted = found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    counted = materialize(counted.select("key", "last"), "line-keys")
    drops = found.join(counted, "key").where("doc_id < last").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    @F.pandas_udf("struct<kept_text: string, n_dropped: long>")
    def rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out, gone = [], []
        for text, drop in zip(texts, drops, strict=True):
            n = 0
            if drop is not None:
                drop, lines = {x.encode("utf-8", "surrogatepass") for x in drop}, text.encode("utf-8", "surrogatepass").split(b"\n")
                kept = [x for x in lines if len(x) < min_chars or line_key(x) not in drop]
                text, n = b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines) - len(kept)
            out.append(text)
            gone.append(n)
        return pd.DataFrame({"kept_text": pd.Series(out, dtype=object), "n_dropped": pd.Series(gone, dtype="int64")})

    n_lines = lambda c: F.size(F.split(c, "\n", -1)).cast("long").alias("n_lines")
    clean = marked.where(F.size("suspects") == 0).select("doc_id", text.alias("kept_text"), n_lines(text), F.lit(0).cast("long").alias("n_dropped"))
    met = marked.where(F.size("suspects") > 0).select("doc_id", "text").join(drops, "doc_id", "left")
    met = met.select("doc_id", n_lines(F.col("text")), rewrite("text", "drop").alias("r")).select("doc_id", "r.kept_text", "n_lines", "r.n_dropped")
    return clean.union(met).withColumn("doc_id", show_null("doc_id"))


def dedup_lines_digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
