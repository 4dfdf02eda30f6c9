"""Exact deduplication by distributed MSD radix partitioning.

The first digit is the length of the normalised text in bytes, the next ones are runs of its bytes. Each round splits
every group by the next digit; a group of one row is unique and leaves, rows that end together in a group are copies
and leave as a class, and the rest goes on with what follows the digit. Digits widen from round to round, so a text of
L bytes takes O(log L) rounds, very long texts too. Texts are compared byte by byte: no digest decides equality. Digits
are counted with map-side partial aggregation, so a group with a third of all rows sends one row for each map task.

Texts move only where they must. A round's groups of several rows are put into a Bloom filter, which is sent to the
tasks; rows that it lacks are unique and leave where they stand. It has 16 to 32 bits for each group, in up to
most_blocks blocks (a power of two) of 256 bits; with more than some 16 million groups the bits a group get fewer and
more unique rows move, but the result does not change. The others meet their groups by a sort-merge join at every size,
so that shuffles grow as the input and don't jump where a table outgrows the limit for broadcasts. The groups are
written before rows meet them, so adaptive execution splits the join's hot groups, which it can't where rows and counts
come from one exchange. Every round is written to the shared folder.

Null text counts as empty. Empty texts are copies of each other. A null doc_id sorts after all others and stays only
in a group of nulls. Of rows that repeat doc_id and text, one stays. Empty tables give no rows. Other columns are
ignored by exact_dedup and kept by drop_copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, drop_paths, materialize


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WS_RUN, " ")


def having_groups(keyed: DataFrame, groups: DataFrame, keys: list[str], most_blocks: int = 2**20) -> DataFrame:
    """The rows of keyed that have a row in groups, and few of the others: a Bloom filter of blocks of four words, a bit a word for each key."""
    blocks = min(2 ** (groups.count() // 16).bit_length(), most_blocks)

    def masked(df: DataFrame) -> DataFrame:
        df = df.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bits", F.xxhash64("_hash"))
        # no column may be null to Spark: its test for null would normalise the text once more
        return df.withColumn("_block", F.expr(f"_hash & {blocks - 1}L")).withColumns({f"_mask{k}": F.expr(f"shiftleft(1L, cast(shiftright(_bits, {6 * k}) & 63 AS INT))") for k in range(4)})

    bits = masked(groups.select(*keys)).groupBy("_block").agg(*[F.bit_or(f"_mask{k}").alias(f"_word{k}") for k in range(4)])
    met = masked(keyed).join(F.broadcast(bits), "_block")
    return met.where(" AND ".join(f"_word{k} & _mask{k} <> 0" for k in range(4))).select(*keyed.columns)


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, made: list[Column] | None = None, first_width: int = 64, widen: int = 4, id_col: str = "doc_id", text_col: str = "text", left: list[str] | None = None) -> DataFrame:
    """A row for each input row: uid, doc_id, keep_id, group_size, kept, carry (a struct of columns of docs) and made.

    made: columns over _text, the text as given, and carry; they are computed before rows meet their verdicts.
    left: gets the paths of the written stages that the result reads.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry or []]).alias("carry"),
    ).withColumn("_uid", F.monotonically_increasing_id()), "radix-rows", left)
    state = rows.select("_uid", "_id", normalized(F.col("_text")).cast("binary").alias("rest")).withColumn("gid", F.length("rest").cast("long"))
    done, spent, width = [], [], first_width
    while True:
        keyed = state.select("_uid", "_id", "gid", F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended"), F.substring("rest", width + 1, 2**31 - 1).alias("rest"))
        groups = keyed.groupBy("gid", "digit", "ended").agg(
            F.min("_uid").alias("next"), F.count("*").alias("group_size"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_uid")).alias("first")).where("group_size > 1")
        groups, keys = materialize(groups, "radix-groups", spent), ["gid", "digit", "ended"]
        met = materialize(having_groups(keyed, groups, keys).join(groups.hint("merge"), keys).select(
            "_uid", "_id", F.col("next").alias("gid"), "rest", "ended", "group_size", F.col("first._id").alias("keep_id"), F.col("first._uid").alias("keep_uid")), "radix", spent)
        done.append(met.where("ended").select("_uid", "group_size", "keep_id", "keep_uid"))
        state = met.where("not ended").select("_uid", "_id", "gid", "rest")
        if state.isEmpty():
            break
        width *= widen
    members = materialize(reduce(DataFrame.union, done), "radix-members", left)
    drop_paths(spark, spent)
    made = made or []
    out = rows.select("_uid", "_id", "carry", *made).join(members, "_uid", "left")
    return out.select(
        F.col("_uid").alias("uid"), F.col("_id").alias("doc_id"), F.when(F.col("keep_uid").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.coalesce("keep_uid", "_uid") == F.col("_uid")).alias("kept"), *[c for c in out.columns[2:] if c in ("carry", "_text", "text_sha256")])


def exact_dedup_digests(docs: DataFrame) -> DataFrame:
    """exact_dedup with the SHA-256 of the normalised text."""
    d = exact_dedup(docs, made=[F.sha2(normalized(F.col("_text")), 256).alias("text_sha256")])
    return d.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, left: list[str] | None = None) -> DataFrame:
    """docs without the copies; original texts and columns stay. left: as for exact_dedup."""
    names = docs.columns
    kept = exact_dedup(docs, carry=[c for c in names if c != "text"], made=[F.col("_text")], left=left).where("kept")
    return kept.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"carry.`{c}`").alias(c) for c in names])
