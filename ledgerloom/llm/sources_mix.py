"""Mixing sources to target weights (operator 10).

Tokens (words) are summed per source; a source's repetition rate is its target
over its own size.  Each document is emitted ``floor(rate)`` times, plus one
copy when a coin seeded by its id falls below the fraction.  Only counters
move: texts are read, never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Source rows up to which the rate table is broadcast (about 5 MB); beyond, a salted shuffle join is used.
BROADCAST_SOURCES = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of words as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def coin(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) fixed by the id and the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources take ``weights`` in turn by code point, null last.  Targets share
    the total by weight; none exceeds ``max_rate`` times its source's size, and
    the excess is shared again by weight.  In ascending order of cap over
    weight, the level left for the rest after the caps before it rises as long
    as sources are capped and falls afterwards, so its maximum is the final one.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_rate)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = capped.withColumn("level", level.cast("double"))
    return leveled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def mix_plan(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, seed: int = 17) -> DataFrame:
    """``documents`` with mix_size, mix_source_size, mix_target and mix_copies (how often to emit it).

    Null or empty texts have size 0 and follow their source's rate; a null
    source is a source of its own; repeated rows with one id share one coin;
    an empty table gives an empty one.  Columns of these names are replaced.
    """
    spark = documents.sparkSession
    sized = documents.withColumn("mix_size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col("mix_size").alias("size")), weights, max_rate)
    rows = targets.limit(BROADCAST_SOURCES + 1).collect()
    targets = spark.createDataFrame(rows, targets.schema) if len(rows) <= BROADCAST_SOURCES else targets
    targets = targets.select(F.col("source").alias("__mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    sized = sized.drop("mix_source_size", "mix_target", "mix_copies")
    if len(rows) <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("__mix_key")), "left")
    else:
        sized = sized.withColumn("__mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        targets = targets.withColumn("__mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__mix_key")) & (F.col("__mix_salt") == F.col("__mix_salt2")), "left").drop("__mix_salt", "__mix_salt2")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(coin(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.drop("__mix_key").withColumn("mix_copies", copies.cast("long"))


def mix_documents(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as often as its plan says, with the columns of ``documents``."""
    whole = documents.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    plan = mix_plan(whole, weights, max_rate, seed).where("mix_copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mix_plan(documents)
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
