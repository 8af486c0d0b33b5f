"""A training-data pipeline: language, quality, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import co_training, jaccard_join, language_id, packing, sources_mix, tokens
from ledgerloom.operators.relational import first_seen
from ledgerloom.storage import materialize

#: A document whose language is no surer than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def _as(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a null or letterless text goes."""
    model = language_id.train(docs.where(language_id.in_training(F.col("doc_id"))))
    found = language_id.identify(docs, model, ("__lang", "__lang_score"))
    return _as(docs, found.where((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__lang_score") > LEAST_LANGUAGE_SCORE)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep."""
    model = co_training.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as(docs, co_training.score(docs, model, ("__text", "__page", "__score", "__kept")).where("__kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the least doc_id, once.

    Of rows with one id the first by text stays.  Rows with a null id stay.
    Ids that go are fewer than those that stay, so they are what is joined.
    """
    found = jaccard_join.similar(docs, words=5, num=80, den=100).where("doc_id is not null")
    status = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    status = materialize(status.where("not first or n > 1"), "near-status")
    kept = docs.join(status.where("not first").select("doc_id"), "doc_id", "left_anti")
    repeated = status.where("first and n > 1").select("doc_id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        again = first_seen(again, ["row.doc_id"], F.asc("row.text"), F.asc("row.source")).select("row.*")
        kept = _as(docs, kept.join(repeated, "doc_id", "left_anti")).unionByName(again)
    return _as(docs, kept)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return sources_mix.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a repeated document is packed each time."""
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models and token ids can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
