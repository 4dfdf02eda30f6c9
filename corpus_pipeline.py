"""A training corpus in five stages: judge, drop copies, join near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Near copies share at least 80 % of their five-word shingles. The operators of echolot.llm define what becomes of nulls,
empty and very long texts, ties, repeated rows, empty tables and other columns; here in short:

- judge: a null text is judged as an empty line; repeated rows are judged alike; other columns stay.
- drop_copies: a null text counts as empty and empty texts are copies; a null doc_id comes last; of repeated rows one
  stays; other columns are those of the row that stays.
- drop_near_copies: texts without words all stay; a null doc_id comes last; rows are told apart by doc_id and text.
- mix_sources: a null source is one source; a text without words is in every whole epoch; other columns are repeated.
- pack_sequences: a null text is the end token alone; a null doc_id is kept; other columns are left behind.

Empty tables give empty results, and very long texts are handled whole, everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echolot.llm import exact_dedup, mixing, ngram_join, packing, quality_classifier
from echolot.llm.common import drop_paths, materialize, root_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stages() -> list[tuple[str, Stage]]:
    """The five stages of one run. They share what a run has to delete: written parts that a stage's result reads.

    A stage begins when its predecessor has been written and read again; what that was made from goes then.
    """
    left: dict[str, list[str]] = {"exact_dedup": [], "ngram_jaccard_join": [], "source_mixing": [], "best_fit_packing": []}

    def free(spark: SparkSession, docs: DataFrame, before: str) -> None:
        used = "\n".join(root_paths(docs))
        gone = [x for x in left[before] if x.rpartition("/")[2] not in used]
        left[before][:] = [x for x in left[before] if x not in gone]
        drop_paths(spark, gone)

    def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Documents that the quality classifier rejects go."""
        return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Of equal texts the smallest doc_id stays."""
        return exact_dedup.drop_copies(docs, left["exact_dedup"])

    def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Of documents linked by similarity the smallest doc_id stays."""
        free(spark, docs, "exact_dedup")
        return ngram_join.one_of_each(docs, width=5, num=80, den=100, slices=4, left=left["ngram_jaccard_join"])

    def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Documents as often as the mix takes them."""
        free(spark, docs, "ngram_jaccard_join")
        return mixing.repeat_mixed(docs, left=left["source_mixing"])

    def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """The places of all pieces in sequences of at most 4096 tokens."""
        free(spark, docs, "source_mixing")
        return packing.best_fit(docs, left=left["best_fit_packing"])

    return [
        ("quality_classifier", judge),
        ("exact_dedup", drop_copies),
        ("ngram_jaccard_join", drop_near_copies),
        ("source_mixing", mix_sources),
        ("best_fit_packing", pack_sequences),
    ]


#: For callers that write and read between the stages themselves, one run at a time; run has stages of its own.
STAGES = stages()

#: A trained model, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in stages():
        written: list[str] = []
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", written)
        drop_paths(spark, read)
        read = written
    return docs
