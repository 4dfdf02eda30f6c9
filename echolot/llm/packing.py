"""Best-fit packing planned over the histogram of lengths.

Documents are tokenised and cut into pieces of at most capacity tokens. Best-fit decreasing is then run over counts:
the histogram has at most capacity entries whatever the number of documents, bins of equal fill are one entry, and a
length with its count is placed on whole runs of bins at once. The plan is a list of segments (length, ranks, first
sequence, pieces for each sequence, offset), with at most three new segments for each length and bins run it touches;
it is bounded by the capacity and is all that reaches the driver. Pieces take their slots by their rank within their
length. Ranks do not need a length in one task: heavy lengths are cut into hashed buckets of about bucket_rows rows,
the buckets' counts are summed up in order, and rows are numbered within their bucket.

A null text is empty and becomes the end token alone. Repeated rows are packed each for itself. Other columns are
ignored. An empty table gives no rows. Pieces with equal columns may exchange their places in a rerun.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hide_null, materialize, ship, show_null, with_rows

END = 1
#: White space in which the tokenizer's pattern and str.split differ, or might.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A stop or comma that ends a word is a word of the splitter's own.
_STOP = re.compile("(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n])")
_END = END.to_bytes(4, "little")


def byte_marks() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of a tokenizer file that normalises to lower-case NFC and splits by a pattern: merges run once for each word.

    The splitter's words are encoded independently of each other, so ids of a text are those of its words in order. A
    text that lower-casing leaves in NFC is cut at white space here, then by the tokenizer's own pattern, and only the
    merges are asked for; their results are remembered, in two generations of so many words: when the younger is full
    it becomes the older, and words still in use are taken over. Any other text (added tokens, letters that compose
    anew, a capital sigma, unusual white space) goes through the tokenizer whole.
    """

    def __init__(self, name: str, remembered: int = 250_000):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in made["normalizer"]["normalizers"]]
        cut, marks = made["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or cut["type"] != "Split" or not cut["invert"] or marks["type"] != "ByteLevel" or marks["add_prefix_space"] or marks["use_regex"]:
            raise ValueError(f"{name} is not a tokenizer of the kind that this encoder reads")
        self.pattern, self.marks = regex.compile(cut["pattern"]["Regex"]), byte_marks()
        every = [*self.marks.values()]
        del self.marks[ord(" ")]  # stands between words
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, end = self.tokenizer.get_vocab(with_added_tokens=False), made["model"]["end_of_word_suffix"]
        if any(x not in vocabulary for c in every for x in (c, c + end)):
            raise ValueError(f"{name} does not know all bytes")
        #: whether an id ends a word
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith(end)]] = True
        self.added = tuple(x["content"] for x in made["added_tokens"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remembered = remembered

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit words."""
        low = text.lower()
        odd = _ODD_SPACE.search(text) or any(x in text or x in low for x in self.added)
        if odd or not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low)):
            return np.array(self.plain(text), "<u4").tobytes()
        runs, young = _STOP.sub(r" \1", low).split(), self.young
        ids = list(map(young.get, runs))
        if None in ids:
            self._learn({r for r, x in zip(runs, ids, strict=True) if x is None})
            ids = map(young.__getitem__, runs)
            if len(young) > self.remembered:
                self.old, self.young = young, {}
        return b"".join(ids)

    def _learn(self, runs: set[str]) -> None:
        young, old = self.young, self.old
        cut, words = {}, set()
        for r in runs:
            if r in old:
                young[r] = old[r]
            elif r.isalpha():
                words.add(r)
            else:
                cut[r] = self.pattern.findall(r)
                words.update(x for x in cut[r] if x not in young)
        new = []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w not in young:
                new.append(w)
        if new:
            shown = " ".join(new)
            if not shown.isascii() or not shown.isprintable():
                shown = shown.encode("utf-8").decode("latin-1").translate(self.marks)
            ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            data, at = ids.tobytes(), 0
            for w, end in zip(new, ends, strict=True):
                young[w] = data[4 * at : 4 * end]
                at = end
        for r, parts in cut.items():
            young[r] = b"".join([young[x] for x in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def pieces_of(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with_ids the ids as little-endian unsigned 32-bit words."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = enc.packed(text or "") + _END
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    data = ids[4 * at : 4 * (at + capacity)]
                    rows.append((i, k, at, len(data) // 4, zlib.crc32(data)) + ((data,) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(hide_null("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        with_rows(cut), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).withColumn("doc_id", show_null("doc_id"))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: segments (length, first rank, first sequence, pieces a sequence, offset).

    A segment ends where the next of its length begins. Runs of sequences with equal room are (first, number).
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted keys of room
    segments, opened = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            else:
                left, first = capacity, opened
                n = -(-count // (capacity // length))
                opened += n
            each = left // length
            segments.append((length, rank, first, each, capacity - left))
            whole = min(n, count // each)
            keep(left - each * length, first, whole)
            count -= whole * each
            rank += whole * each
            if whole < n:
                if count:
                    keep(left - count * length, first + whole, 1)
                    rank, count, whole = rank + count, 0, whole + 1
                keep(left, first + whole, n - whole)
    return segments


def ranked(pieces: DataFrame, group: str, order: list[Column], hashed: list[Column], bucket_rows: int) -> DataFrame:
    """Adds rank, from 0 within group; heavy groups are numbered by buckets of about bucket_rows rows."""
    sizes = pieces.groupBy(group).agg(F.ceil(F.count("*") / bucket_rows).alias("_b"))
    cut = pieces.join(sizes, group).withColumn("_k", F.pmod(F.xxhash64(*hashed), F.col("_b"))).drop("_b")
    counts = cut.groupBy(group, "_k").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_k")) - F.col("_n")).drop("_n")
    row = F.row_number().over(Window.partitionBy(group, "_k").orderBy(*order)) - 1
    return cut.withColumn("_row", row).join(before, [group, "_k"]).withColumn("rank", (F.col("_before") + F.col("_row")).cast("long")).drop("_row", "_before", "_k")


def pack(pieces: DataFrame, capacity: int = 4096, bucket_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces, a table that reads the same twice, with doc_id, piece, start, length."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("lengths lie between 1 and the capacity")
    segments = np.array(sorted(plan(histogram, capacity)) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    keys = segments[:, 0] * 2**48 + segments[:, 1]
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * 2**48 + rank.to_numpy(), side="right") - 1
        s = segments[at]
        nth = rank.to_numpy() - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 2] + nth // s[:, 3], "offset": s[:, 4] + nth % s[:, 3] * s[:, 0]})

    return ranked(pieces, "length", order, keyed, bucket_rows).withColumn("_s", slot("length", "rank")).select(
        *pieces.columns, F.col("_s.sequence_id").alias("sequence_id"), F.col("_s.offset").alias("offset"))


def best_fit(docs: DataFrame, capacity: int = 4096, left: list[str] | None = None) -> DataFrame:
    """The places of all pieces of docs. left: gets the path of the pieces, which the result reads."""
    return pack(materialize(pieces_of(docs, capacity), "pieces", left), capacity)


def sequences(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids as an array, doc_ids and starts of what they hold."""
    packed = pack(materialize(pieces_of(docs, capacity, with_ids=True), "pieces"), capacity)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": pdf["sequence_id"].iloc[:1], "ids": [ids], "doc_ids": [pdf["doc_id"].tolist()], "offsets": [pdf["offset"].tolist()]})

    return packed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, doc_ids array<long>, offsets array<long>")  # a group is one sequence, of at most capacity ids
