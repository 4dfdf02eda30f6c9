"""WARC archives, index first.

The writer puts records, each a gzip member of its own, into one archive for each task and returns the index: file,
offset, length, URL and digest of each record. The reader works from the index alone: the records that a query
selects are sorted by file and offset, near ranges are coalesced into reads of at most span_bytes, and every range is
read once. Files get names of their own for each attempt, so a lost executor's task writes again without harm, and
only files in the written index count.

Of pages with equal payloads of at least min_bytes the one with the largest page_id is a response and the others are
revisits of it, written without the payload; smaller payloads are all responses. A revisit names its response by the
standard headers WARC-Refers-To, -Target-URI and -Date, every archive begins with a warcinfo record, and record ids
are made of the folder and the page_id, so both sides know them without a lookup. Payloads are equal if their SHA-1
and length are; their groups are written before pages meet them, so a hot payload's pages can be split. A null html is an empty payload, a null url an empty one. Rows that repeat the largest page_id of
their payload are all responses. A null page_id is smaller than all others and is kept as null. Empty tables write no
archive. Very long pages are one record each, held whole in one task. Other columns are ignored. Paths can be of any store that pyarrow.fs opens by URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONE, materialize, scratch, ship, show_null, with_rows

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(folder: str, page: int) -> str:
    """The id of a page's response; pages without an id, and repeated ones, get one of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}#{page}')}>"


def record(kind: str, url: str, payload: bytes, headers: dict[str, str], date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    if kind == "warcinfo":
        block = payload
        head = {"WARC-Type": kind, "WARC-Date": date, "Content-Type": "application/warc-fields"} | headers
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
        head = {"WARC-Type": kind, "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response"} | headers
    head = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"} | head
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP body of a record."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) into archives below folder; returns the index, itself written there."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.cast("binary").alias("payload")).withColumns(
        {"sha": F.sha1("payload"), "n": F.length("payload")})
    groups = p.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.max_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialize(groups, "warc-groups")
    # slim rows find their group; whole pages then find their verdict by ids, which no hot payload piles up
    revisits = p.select("page_id", "sha", "n").join(groups.drop("copies"), ["sha", "n"]).where("first is not null and (page_id is null or page_id < first)").select(
        "sha", F.coalesce("page_id", F.lit(NONE)).alias("id"), "first", "first_url").distinct()
    met = p.withColumn("id", F.coalesce("page_id", F.lit(NONE))).join(revisits, ["id", "sha"], "left").select("id", "url", "payload", F.coalesce("first", F.lit(NONE)).alias("first"), "first_url")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # pages of this archive; it is as large as a task's share of pages
        out, at, name, fs = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz", None
        for pdf in batches:
            rows = []
            for page, url, payload, first, first_url in zip(pdf["id"].tolist(), pdf["url"], pdf["payload"], pdf["first"].tolist(), pdf["first_url"], strict=True):
                if out is None:
                    fs, path = _fs(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    info = record("warcinfo", "", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": path.rpartition("/")[2]}, date)
                    out.write(info)
                    at = len(info)
                own = digest(payload)
                headers = {"WARC-Payload-Digest": f"sha1:{own}", "X-Payload-Length": str(len(payload))} | ({} if page == NONE else {"X-Page-Id": str(page)})
                if first == NONE:
                    if page != NONE and page not in seen:
                        seen.add(page)
                        headers["WARC-Record-ID"] = record_id(folder, page)
                    data = record("response", url, payload, headers, date)
                else:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    data = record("revisit", url, b"", headers | {"WARC-Profile": profile, "WARC-Refers-To": record_id(folder, first), "WARC-Refers-To-Target-URI": first_url or "", "WARC-Refers-To-Date": date,
                                                             "X-Refers-To-Page-Id": str(first)}, date)
                out.write(data)
                rows.append((name, at, len(data), url, own, page))
                at += len(data)
            yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()

    index = met.mapInPandas(with_rows(write), INDEX).withColumn("page_id", show_null("page_id"))
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def read_records(index: DataFrame, span_bytes: int = 2**23, gap_bytes: int = 2**16) -> DataFrame:
    """The pages of the index's rows. Rows of one range of a file go to one task; ranges are read in the order they lie.

    There are as many tasks as the records' bytes fill spans: the number is named, so that it does not follow the
    index's own few bytes.
    """
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // span_bytes) or 1
    placed = index.withColumn("span", F.floor(F.col("offset") / span_bytes)).repartition(tasks, "file", "span").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, opened = None, None
        for pdf in batches:
            rows, todo = [], list(zip(pdf["file"], pdf["offset"], pdf["length"], strict=True))
            k = 0
            while k < len(todo):
                file, start, length = todo[k]
                end, last = start + length, k
                while last + 1 < len(todo) and todo[last + 1][0] == file and todo[last + 1][1] - end <= gap_bytes and todo[last + 1][1] + todo[last + 1][2] - start <= span_bytes:
                    last += 1
                    end = todo[last][1] + todo[last][2]
                if opened != file:
                    if source is not None:
                        source.close()
                    fs, path = _fs(file)
                    source, opened = fs.open_input_file(path), file
                source.seek(start)
                data = source.read(int(end - start))
                for _, at, n in todo[k : last + 1]:
                    h, body = parse(data[at - start : at - start + n])
                    own = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and digest(body) != own:
                        raise ValueError(f"digest differs in {file} at {at}")
                    rows.append((int(h.get("X-Page-Id", NONE)), h["WARC-Target-URI"], body, int(h["X-Payload-Length"]), own, h["WARC-Type"], int(h.get("X-Refers-To-Page-Id", NONE))))
                k = last + 1
            yield pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return placed.select("file", "offset", "length").mapInPandas(with_rows(read), PAGE).withColumns({c: show_null(c) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages, reads all records back by the index and returns their headers."""
    index = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
