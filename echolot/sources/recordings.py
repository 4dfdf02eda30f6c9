"""WAV recordings as tables: scan, header, samples, ranges, and a sink."""

from __future__ import annotations

import io
import os
import struct
import tempfile
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import ship


def scan(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Path, modificationTime, length, content; content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Unset, local masters get one of their own; clusters must name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="echolot-")
        sc.setCheckpointDir(where)
    return f"{where.rstrip('/')}/echolot/{tag}-{uuid.uuid4().hex}"


def duration_from_size(length: Column, fs: int, bytes_per_sample: int = 2, channels: int = 1) -> Column:
    """No read."""
    return (length - 44) / (bytes_per_sample * channels) / fs


def header(content: bytes) -> tuple[int, int, int, int] | None:
    """S3: rate, channels, bytes a sample, frames; null for anything else than PCM WAV."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, n = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(content):
            fmt = struct.unpack_from("<HHIIHH", content, at + 8)
        if name == b"data" and fmt and fmt[4]:
            return fmt[2], fmt[1], fmt[5] // 8, n // fmt[4]
        at += 8 + n + n % 2
    return None


def samples(content: bytes) -> np.ndarray | None:
    """The first channel in -1..1."""
    try:
        with wave.open(io.BytesIO(bytes(content))) as w:
            raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float32) / 2 ** (8 * width - 1)
    return x[::channels]


def read(files: DataFrame) -> DataFrame:
    """Path, fs, n, samples, fail_comment; a file that can't be read keeps its row and says so."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                h = header(bytes(content))
                x = samples(content) if h else None
                rows.append((path, h[0] if h else None, len(x) if x is not None else None, x, None if x is not None else "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "fs", "n", "samples", "fail_comment"]).astype({"fs": "Int64", "n": "Int64"})

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(decode, "path string, fs int, n long, samples array<float>, fail_comment string")


def headers(files: DataFrame) -> DataFrame:
    """S3: path, fs, channels, width, n and bytes, from the first 4 KB; all null where no PCM header is among them."""
    def scan_them(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                h = [header(bytes(x)) or (None,) * 4 for x in pdf["head"]]
                yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["bytes"]} | {c: pd.array([x[i] for x in h], "Int64") for i, c in enumerate(("fs", "channels", "width", "n"))})

    few = files.select("path", F.substring("content", 1, 4096).alias("head"), F.octet_length("content").cast("long").alias("bytes"))
    ship(files.sparkSession)
    return few.mapInPandas(scan_them, "path string, bytes long, fs int, channels int, width int, n long")


def with_wav(rows: DataFrame, samples: str, fs: int, to: str = "content") -> DataFrame:
    """Adds each row's samples as the bytes of a WAV file; null samples give null."""
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else to_wav(v, fs))

    ship(rows.sparkSession)
    encode.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return rows.withColumn(to, F.pandas_udf(encode, "binary")(samples))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content under its name into a folder that all executors mount: name, error (null if written).

    A file that can't be written keeps its row and does not stop the others. A file appears whole under its name or not
    at all, so tasks may run again.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                try:
                    with open(part, "wb") as f:
                        f.write(content)
                    os.replace(part, os.path.join(folder, name))
                    out.append((name, None))
                except (OSError, TypeError) as e:
                    out.append((name, str(e)))
            if out:
                yield pd.DataFrame(out, columns=["name", "error"], dtype=object)

    ship(files.sparkSession)
    return files.select("name", "content").mapInPandas(put, "name string, error string")


def only_match(spark: SparkSession, pattern: str) -> str:
    """The one path that a pattern meets; anything but one is an error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    if len(found) != 1:
        raise ValueError(f"{len(found)} paths meet {pattern}, not one")
    return found[0].getPath().toString()


def read_range(recordings: DataFrame, first: Column | int, n: Column | int) -> DataFrame:
    """Samples first..first + n - 1."""
    return recordings.withColumn("samples", F.slice("samples", first, n))


def to_wav(x: np.ndarray, fs: int) -> bytes:
    """16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(fs)
        w.writeframes((np.clip(np.asarray(x), -1, 1 - 2**-15) * 2**15).astype("<i2").tobytes())
    return out.getvalue()


def tab_delimited(spark: SparkSession, path: str, required: list[str], schema: str) -> DataFrame:
    """A table with a header; all required columns must be there."""
    names = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The written table if it is complete, else make() written there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unprocessed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a resumed run has still to do."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def readable(recordings: DataFrame) -> DataFrame:
    """The recordings that could be read."""
    return recordings.where("fail_comment is null")


def append_report(df: DataFrame, path: str) -> None:
    """S10"""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """S11"""
    df.write.mode("overwrite").option("header", True).csv(path)


def newest(files: DataFrame) -> DataFrame:
    """T3"""
    return files.agg(F.max_by("path", "modificationTime").alias("path"))
