"""Corpus pipeline: quality, exact dedup, near-dedup, benchmark decontamination, mixture.

Every stage but the last returns whole rows with the columns of its input, whatever they are; the last
returns what the mixture takes of each document that is left. Stages are functions of (spark, docs,
sf_dir); run() writes each one's result to the shared folder as Parquet and rereads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import drop_table, materialize, read_table, scratch, text_hash
from quillgraph.llm.decontamination import contaminated
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.mixing import mix
from quillgraph.llm.quality import classify, train
from quillgraph.llm.simhash import near_duplicates

#: Below this probability of good quality a document goes.
QUALITY_THRESHOLD = 0.5
#: Benchmark items of fewer words are found by op6 but delete nothing: a few words in a row stand in many clean documents.
LEAST_ITEM_WORDS = 13
#: Rows to delete, two numbers each, that may be broadcast; beyond, texts are shuffled to meet them.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """Rows of docs that meet none of gone; few of these, by their count, go to every task, so that texts stay where they are."""
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go. Without labels all stay."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return classify(docs, train(docs.select("doc_id", "text"), labels), QUALITY_THRESHOLD)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays, whole: the longest original, then the smallest id."""
    return exact_dedup(docs, carry=docs.columns).kept()


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (shingles of five words, similarity 0.8) one stays: the smallest id, then the smallest text hash.

    Rows are told apart by id and text, so a row goes only by what its own text is linked with; of
    linked rows one without an id stays only if none has one. Rows identical in both stay or go together.
    """
    found = near_duplicates(docs.select("doc_id", "text"), 5, 0.8)
    gone = materialize(found.filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text_hash(docs["text"]) == gone["gone_hash"])
    return _without(docs, gone, same)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a stretch of a benchmark item of LEAST_ITEM_WORDS words or more go, each by its own text: other texts of its id stay."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    row = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    found = contaminated(docs.select(row.alias("doc_id"), "text"), items)
    gone = materialize(found.filter(F.col("item_words") >= LEAST_ITEM_WORDS).select(F.col("doc_id").alias("gone_row")), "gone")
    return _without(docs, gone, row == gone["gone_row"])


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mix(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]
#: The classifier, SimHash and seeded blocks can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as tables:  # what the stage writes on its way goes with it
            docs = tables.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
