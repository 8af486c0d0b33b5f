"""Writers: create-if-missing, append, replace, upsert by key, JSON lines, Markdown, registries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.relational import upsert_latest


def create_if_missing(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def append_points(points: DataFrame, path: str) -> None:
    """Points under new random ids: writing the same chunks again repeats them."""
    points.withColumn("point_id", F.uuid()).write.mode("append").partitionBy("collection").parquet(path)


def replace_collections(points: DataFrame, path: str) -> None:
    """Write points, replacing only the collections that occur among them."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def stable_ids(chunks: DataFrame) -> DataFrame:
    """Ids from path, page and chunk, the same at every ingestion."""
    name = F.concat_ws(":", F.col("path"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("chunk_index").cast("string"))
    return chunks.withColumn("point_id", T.url_id(name))


def content_ids(chunks: DataFrame) -> DataFrame:
    """Ids from the collection, section, chunk and text."""
    return chunks.withColumn("point_id", T.content_id(F.col("collection"), F.col("section"), F.col("chunk_index").cast("string"), F.col("text")))


def upsert(updates: DataFrame, path: str, key: str, *order: Column) -> str:
    """The table at ``path`` (a folder of versions) after the updates; returns the new version's folder.

    Stored rows come before updates; among updates the last by ``order`` wins.
    Readers of the old version aren't disturbed: the caller moves on to the
    returned folder.
    """
    spark = updates.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().toString() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
    fresh = upsert_latest(updates, key, *order)
    if versions:
        kept = spark.read.parquet(versions[-1]).join(fresh.select(key), key, "left_anti")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    target = f"{path}/v{len(versions):08d}-{uuid.uuid4().hex[:8]}"
    fresh.write.parquet(target)
    return target


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions that upsert() wrote below ``path``; returns what went."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted((s.getPath() for s in fs.listStatus(hadoop)), key=lambda p: p.toString()) if fs.exists(hadoop) else []
    old = versions[: max(0, len(versions) - max(1, keep))]
    for version in old:
        fs.delete(version, True)
    return [v.toString() for v in old]


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def markdown(pages: DataFrame, path: str) -> None:
    """Pages (slug, title, url, body) as Markdown text: a folder a slug, and below it one a page, named after its url's path."""
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nURL: "), F.col("url"), F.lit("\n\n"), F.col("body"))
    name = T.safe_file_name(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    pages.select("slug", name.alias("file"), body.alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").partitionBy("slug", "file").text(path)


def register_new(entries: DataFrame, existing: DataFrame, path: str) -> None:
    """Append registry entries, a file each in a folder named by the slug of its name; ValueError for an empty slug or one that is taken."""
    named = entries.withColumn("id", T.slug(F.col("name"), ampersand=False))
    bad = named.where(F.coalesce(F.col("id"), F.lit("")) == "").limit(1)
    taken = named.join(existing.select("id"), "id", "left_semi").limit(1)
    if not bad.isEmpty():
        raise ValueError("an entry has no name")
    if not taken.isEmpty():
        raise ValueError(f"taken: {taken.first().id}")
    named.withColumn("entry", F.col("id")).write.mode("append").partitionBy("entry").json(path)
