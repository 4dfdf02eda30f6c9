"""What the training-data operators share: the shared folder, written stages, text rules, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it; elsewhere pass it by --py-files.

    Arrow batches are bounded by bytes, unless the session has a bound of its own: texts may be long.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(2**22))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, local masters get one of their own; clusters must name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="echolot-")
        sc.setCheckpointDir(where)
    return f"{where.rstrip('/')}/echolot"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    ship(spark)
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost one stage."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written stages that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def root_paths(df: DataFrame) -> list[str]:
    """The folders and files that df reads, as named to the reader."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    relations = [x.relation() for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    return [x for r in relations if r.getClass().getSimpleName() == "HadoopFsRelation" for x in r.location().rootPaths().mkString("\n").split("\n")]


def lowered(text: str) -> str:
    """text with A-Z in lower case; bytes know no other letters."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def with_rows(make):
    """make, a function from batches to frames, without its frames that hold no rows: Arrow can't type their columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (pdf for pdf in make(batches) if len(pdf))
    return run


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


#: Stands for a null id in Python code, where pandas would turn ids into floats.
NONE = -(2**63)


def hide_null(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NONE)).alias(name)


def show_null(name: str) -> Column:
    return F.when(F.col(name) != NONE, F.col(name))


def words_of(text: Column) -> Column:
    """The array of maximal runs outside WS; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Forest:
    """Union-find over small integers; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges becomes stars around the smallest id of each of its components."""
    for pdf in batches:
        if not len(pdf):
            continue
        ids, flat = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        f, n = Forest(len(ids)), len(pdf)
        for x, y in zip(flat[:n].tolist(), flat[n:].tolist(), strict=True):
            f.join(x, y)
        roots = np.fromiter((f.root(i) for i in range(len(ids))), np.int64, len(ids))
        far = roots != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[far], "b": ids[roots[far]]})


def contracted(make, rows: int = 10_000):
    """make, a function from batches to frames of edges, with its edges contracted by about so many rows in the same worker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in make(batches):
            held.append(pdf)
            n += len(pdf)
            if n >= rows:
                yield from _contract(iter([pd.concat(held)]))
                held, n = [], 0
        if n:
            yield from _contract(iter([pd.concat(held)]))
    return run


def components(edges: DataFrame, paths: list[str] | None = None, most_rounds: int = 40, contract: bool = True) -> DataFrame:
    """Connected components of edges (a, b: long): a row (id, root) for each id of an edge, root the smallest id.

    Alternating large and small stars over distributed tables; every round is written to the shared folder.
    Batches are contracted locally first, so that repeated edges and chains leave early; contract is False where the
    edges were made so, which saves each task a second Python worker. Empty in, empty out.
    """
    spark = edges.sparkSession
    mine: list[str] = []
    edges = edges.select("a", "b").where("a <> b")
    now = materialize((edges.mapInPandas(with_rows(_contract), "a long, b long") if contract else edges).distinct(), "cc", mine)
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))).distinct()
        old, mine_next = mine[-1], []
        after = materialize(small, "cc", mine_next)
        mine += mine_next
        # a forest of stars is final: no root has a parent, and no id two of them
        moving = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        split = 0 if moving else after.groupBy("a").count().where("count > 1").limit(1).count()
        drop_paths(spark, [old])
        mine.remove(old)
        now = after
        if not moving and not split:
            break
    else:
        raise RuntimeError("components did not settle")
    if paths is not None:
        paths += mine
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
