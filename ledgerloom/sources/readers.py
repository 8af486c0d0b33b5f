"""Readers: tables, text and page files, registries, crawl configurations, chunk indexes, settings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

INSTITUTION = "id string, name string, type string, website string, headquarters string, msme_focus boolean, confidence string, note string, source_docs array<string>, source_urls map<string,string>, qdrant_collection string, slug string"
REGULATION = "id string, display_name string, category string, rbi_url string, source_docs array<string>, qdrant_collection string, applicability string, effective_date string, priority string"
ALERT = "title string, category string, severity string, summary string, action_required string, source_url string, ai_note string"
REVIEW_ITEM = "id string, title string, module string"
PHASE = "name string, status string, detail string"
CRAWL = "id string, slug string, name string, start_url string, category string, collection string, qdrant_collection string, legacy_slug string, description string, max_pages int"


def jdbc_table(spark: SparkSession, url: str, name: str, properties: Mapping[str, str], key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 16) -> DataFrame:
    """A database table; with ``key`` it is read in ``parts`` ranges in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**properties)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def text_files(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text) of whole files, undecodable bytes as replacement characters."""
    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def page_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], Iterable[str]], pattern: str = "*.pdf") -> DataFrame:
    """(path, page, text) of paged files by a plug-in that gives a file's page texts; empty pages are left out, pages count from 1."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(i, t) for i, t in enumerate(pages_of(data), 1) if t and t.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(read, "path string, page int, text string")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, text, lines) of crawled Markdown: the URL line and the cleaned lines that aren't noise."""
    found = text_files(spark, path, "*.md")
    lines = F.filter(F.transform(F.split("text", "\n"), T.clean_line), lambda line: ~T.is_noise(line))
    return found.select("path", F.trim(F.regexp_extract("text", r"(?m)^URL:\s*(.+)$", 1)).alias("url"), "text", lines.alias("lines"))


def registry(spark: SparkSession, path: str, schema: str = INSTITUTION) -> DataFrame:
    """One JSON object a file; malformed files fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)


def static_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A fixed list kept as one JSON array or as objects: alerts (ALERT), review items (REVIEW_ITEM), onboarding phases (PHASE)."""
    return registry(spark, path, schema)


def regulations(spark: SparkSession, path: str) -> DataFrame:
    """The regulation registry; an absent priority is medium."""
    return registry(spark, path, REGULATION).withColumn("priority", F.coalesce("priority", F.lit("medium")))


def one(found: DataFrame, key: str, value: str) -> DataFrame:
    """The registry's entry; KeyError where there is none."""
    row = found.where(F.col(key) == value).limit(1)
    if row.isEmpty():
        raise KeyError(value)
    return row


def source_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of the files (category, file_name, path) that a registry's source_docs name, literally or by * and ?.

    Literal names are an equi-join; only patterns are compared with the files
    of their own category.
    """
    wanted = found.select("id", "category", F.explode("source_docs").alias("doc"))
    glob = F.col("doc").rlike(r"[*?]")
    literal = wanted.where(~glob).join(files, (F.col("doc") == F.col("file_name")) & (wanted["category"] == files["category"])).select("id", "path")
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("doc", r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    patterned = wanted.where(glob).withColumn("_like", like).join(files, wanted["category"] == files["category"]).where(F.expr("file_name rlike _like")).select("id", "path")
    return literal.union(patterned).distinct()


def crawl_configs(spark: SparkSession, path: str) -> DataFrame:
    """Crawl configurations from one object a file, one list, or an object with ``institutions``; ids, slugs and collections fall back."""
    wrapped = spark.read.schema(f"institutions array<struct<{CRAWL.replace(' ', ':').replace(',:', ', ')}>>, {CRAWL}").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    several = wrapped.where("institutions is not null").select(F.explode("institutions").alias("i")).select("i.*")
    found = several.unionByName(wrapped.where("institutions is null").drop("institutions"))
    slug = F.coalesce("id", "slug", T.slug(F.col("name")))
    return found.where(slug.isNotNull()).select(slug.alias("slug"), "name", "start_url", "category", F.coalesce("collection", "qdrant_collection", F.concat(F.lit("comp_"), slug)).alias("collection"), "legacy_slug", "description", F.coalesce("max_pages", F.lit(100)).alias("max_pages"))


def chunk_index(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """A JSON-lines chunk index, of one collection or all."""
    found = spark.read.schema("id string, collection string, document string, source string, path string, page int, chunk_index int, section string, text string").json(path)
    return found if collection is None else found.where(F.col("collection") == collection)


def settings(path: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of a .env file (on the driver), overridden by the environment; comments and quotes are stripped."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                found[key.removeprefix("export ").strip()] = value.split(" #")[0].strip().strip("'\"")
    return found | dict(os.environ if environment is None else environment)
