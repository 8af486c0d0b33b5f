"""Retrieval over collections: dense, lexical, fused and federated search, and context packing.

Queries come with the request: they go to every task in blocks of bounded size,
so each chunk is scored where it lies and each task keeps its own best k per
query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.relational import first_seen, prefix_budget, top_k, top_k_per_group, union_all
from ledgerloom.plans.domain import table, view
from ledgerloom.plans.registry import ORACLES, register
from ledgerloom.storage import materialize, materialize_all

#: Queries that go to the tasks at once: a matrix of 8 MB at 1,024 dimensions.
MOST_QUERIES = 1_000


def bounded(queries: DataFrame, most: int = MOST_QUERIES) -> list:
    """The request's queries as rows; raises ValueError where there are more than a broadcast should hold."""
    rows = queries.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries in one request")
    return rows


def query_blocks(queries: DataFrame, most: int = MOST_QUERIES) -> Iterator[list]:
    """All queries as lists of at most ``most`` rows, each read when it is asked for.

    Up to ``most`` queries are one list.  More are numbered within their tasks
    and written once, so the driver holds the rows of one list, and a count for
    each ``most`` rows of a task.
    """
    rows = queries.limit(most + 1).collect()
    if len(rows) <= most:
        yield rows
        return
    at = F.col("_at")
    numbered = queries.withColumn("_at", F.monotonically_increasing_id())
    written = materialize(numbered.withColumn("_block", at - at.bitwiseAND(F.lit((1 << 33) - 1)) % most), "queries")
    members: list[int] = []
    held = 0
    for block, n in written.groupBy("_block").count().orderBy("_block").collect():
        if held + n > most:
            yield bounded(written.where(F.col("_block").isin(members)).drop("_at", "_block"), most)
            members, held = [], 0
        members.append(block)
        held += n
    yield bounded(written.where(F.col("_block").isin(members)).drop("_at", "_block"), most)


def dense_topk(points: DataFrame, queries: DataFrame, k: int = 5, per_collection: bool = False, block: int = MOST_QUERIES) -> DataFrame:
    """(query_id, collection, point_id, score, hit_rank): the k nearest points of each query, over all or in each collection.

    Embeddings have unit length, so a score is a cosine.  Each task multiplies
    its batches with the matrix of one block of queries and passes on its own
    best k; ties go to the smaller point_id.  Points without an embedding are
    left out.  Several blocks go over the points one after another, and the
    best k of each are written to the shared folder.
    """
    vectors = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = query_blocks(vectors, block)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _block_topk(points, first, k, per_collection)
    return materialize_all((_block_topk(points, rows, k, per_collection) for rows in chain((first, second), blocks)), "dense_topk")


def _block_topk(points: DataFrame, rows: list, k: int, per_collection: bool) -> DataFrame:
    """dense_topk for the queries of one block."""
    ids = [r.query_id for r in rows]
    matrix = np.array([r.embedding for r in rows], np.float64)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            point, collection = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            scores = matrix @ np.stack(batch.column(2).to_numpy(zero_copy_only=False)).T
            groups: dict = {}
            for i, c in enumerate(collection):
                groups.setdefault(c if per_collection else None, []).append(i)
            out: list[tuple] = []
            for members in groups.values():
                at = np.array(members)
                for q, row in zip(ids, scores[:, at]):
                    first = np.lexsort((point[at], -row))[:k]
                    out.extend((q, collection[at[j]], int(point[at[j]]), float(row[j])) for j in first)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["query_id", "collection", "point_id", "score"])

    found = points.where("embedding is not null").select("point_id", "collection", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(best, "query_id long, collection string, point_id long, score double")
    by = ["query_id", "collection"] if per_collection else ["query_id"]
    return top_k_per_group(found, by, k, F.desc("score"), F.asc("point_id"), rank="hit_rank")


def multi_query_fusion(hits: DataFrame, text: str, least: float, most: int) -> DataFrame:
    """Hits of several queries as one list: those under the threshold go first, then a text's first hit in query order stays, then the best."""
    once = first_seen(hits.where(F.col("score") >= least), [F.left(F.col(text), F.lit(300))], F.asc("query_id"), F.asc("hit_rank"))
    return top_k(once, most, F.desc("score"), F.asc("query_id"), F.asc("hit_rank"))


def term_overlap(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The k chunks that share most distinct words with the query; any chunks where none shares one."""
    wanted = F.array_distinct(T.tokens(F.lit(query)))
    scored = chunks.withColumn("score", F.size(F.array_intersect(wanted, F.array_distinct(T.tokens(F.col("text"))))).cast("long"))
    positive = (F.col("score") > 0).cast("int")
    found = top_k(scored, k, F.desc(positive), F.desc("score"), F.asc("doc_id"))
    some = F.max(F.col("score")).over(Window.partitionBy()) > 0
    return found.withColumn("_some", some).where((F.col("score") > 0) | ~F.col("_some")).drop("_some")


def directory_hits(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """(doc_id, hit_rank, whole, text, score): chunks that hold most distinctive query terms, five more for the whole phrase, with an excerpt and a score of at most 0.99."""
    one = chunks.sparkSession.range(1).select(T.directory_terms(F.lit(query)).alias("phrase_terms")).select("phrase_terms", T.core_terms(F.col("phrase_terms")).alias("core")).first()
    terms, core = list(one.phrase_terms or []), list(one.core or [])
    if not core:
        return chunks.select("doc_id", F.lit(0).alias("hit_rank"), F.lit("").alias("whole"), F.lit("").alias("text"), F.lit(0.0).alias("score")).limit(0)
    phrase = " ".join(terms)
    low = chunks.withColumn("_low", F.lower("text"))
    matches = sum((F.col("_low").contains(t).cast("int") for t in core[1:]), F.col("_low").contains(core[0]).cast("int"))
    whole = F.col("_low").contains(phrase)
    scored = low.withColumn("_score", matches + F.when(whole & F.lit(len(terms) > 1), 5).otherwise(0)).where(matches > 0)
    order = F.desc("_score"), F.asc("doc_id")
    best = top_k(scored, k, *order).withColumn("hit_rank", F.row_number().over(Window.orderBy(*order)))
    at = F.when(whole, F.instr("_low", phrase)).otherwise(F.instr("_low", core[0]))
    return best.select("doc_id", "hit_rank", F.col("text").alias("whole"), T.excerpt(F.col("text"), F.greatest(at, F.lit(1))).alias("text"), F.least(F.lit(0.99), F.round(0.5 + F.lit("0.08").cast("decimal(4,2)").cast("double") * F.col("_score"), 2)).alias("score"))


def directory_search(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """directory_hits as (doc_id, text, score)."""
    return directory_hits(chunks, query, k).select("doc_id", "text", "score")


def federated(parts: list[DataFrame], most: int, by: Sequence[str] = ()) -> DataFrame:
    """Hits of several collections (collection_no, hit_rank, text, score): a text's first hit in collection order stays, then the best; of each query where ``by`` names its key."""
    once = first_seen(union_all(*parts), [*by, F.left(F.col("text"), F.lit(300))], F.asc("collection_no"), F.asc("hit_rank"))
    order = F.desc("score"), F.asc("collection_no"), F.asc("hit_rank")
    return top_k_per_group(once, by, most, *order) if by else top_k(once, most, *order)


def block_label(source: Column, page: Column | None = None, spelt: bool = False) -> Column:
    """``[source p.3]``, or ``[Source: source, p.3]`` where ``spelt``; a null, empty or "None" page is left out."""
    head, mark = ("[Source: ", ", p.") if spelt else ("[", " p.")
    text = F.nullif(F.nullif(page.cast("string"), F.lit("")), F.lit("None")) if page is not None else F.lit(None).cast("string")
    return F.concat(F.lit(head), source, F.coalesce(F.concat(F.lit(mark), text), F.lit("")), F.lit("]"))


def _block(hits: DataFrame) -> Column:
    return F.concat(block_label(F.col("source"), F.col("page") if "page" in hits.columns else None), F.lit("\n"), F.col("text"))


def context(hits: DataFrame, by: list[str], budget: int, *order: Column, key: str | None = None) -> DataFrame:
    """Labelled blocks of the hits that fit the budget, joined by blank lines; separators don't count.

    With a unique ``key`` only lengths are sorted: a block has three characters
    at least, so the first ``budget`` / 3 rows of a group hold all that fit (the
    limit is applied in each task), and the texts of the few kept rows are read
    again.  Without one the hits themselves are, for lists of request size.
    """
    if key is None:
        kept = prefix_budget(hits.withColumn("_block", _block(hits)), by, F.length("_block"), budget, *order)
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        sizes = top_k_per_group(hits.withColumn("_size", F.length(_block(hits))).drop("text"), by, budget // 3 + 1, *order, rank="_n")
        fit = materialize(prefix_budget(sizes, by, F.col("_size"), budget, F.asc("_n")).select(key, "_n"), "context")
        kept = hits.join(fit, key).withColumn("_block", _block(hits))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_block"))), lambda s: s["_block"]), "\n\n")
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), joined.alias("context"))


def retrieve(chunks: DataFrame, k: int, question: str | None = None, points: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The k best by vectors (``points`` and ``queries``) or by shared words (``question``): the caller chooses, nothing falls back."""
    if (question is None) == (queries is None):
        raise ValueError("give a question or embedded queries")
    return dense_topk(points, queries, k) if queries is not None else term_overlap(chunks, question, k)


def policy_chunks(points: DataFrame, queries: DataFrame, selected: DataFrame, registry: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, selection_no, hit_rank, collection, point_id, score): the k best of each selected collection, in the order of selection.

    Selected collections that no registry knows are left out; nothing is
    deduplicated and no score is too low.
    """
    known = selected.join(registry.select("collection").distinct(), "collection", "left_semi")
    hits = dense_topk(points.join(known.select("collection"), "collection", "left_semi"), queries, k, per_collection=True)
    return hits.join(known, "collection").select("query_id", "selection_no", "hit_rank", "collection", "point_id", "score")


def landscape_chunks(points: DataFrame, queries: DataFrame, texts: DataFrame, per_query: int = 2, per_collection: int = 3, most: int = 14, least: float = 0.45) -> DataFrame:
    """The best chunks over all collections: of each collection a few hits a query, each text's first in query order, the best of those, then the best of all.

    ``texts`` (point_id, text) names the chunks; only the hits' are joined.
    """
    hits = dense_topk(points, queries, per_query, per_collection=True).where(F.col("score") >= least).join(texts, "point_id")
    once = first_seen(hits, ["collection", F.left("text", F.lit(300))], F.asc("query_id"), F.asc("hit_rank"))
    order = F.desc("score"), F.asc("collection"), F.asc("point_id")
    return top_k(top_k_per_group(once, ["collection"], per_collection, *order), most, *order).select("collection", "point_id", "query_id", "text", "score")


def registry_context(regulations: DataFrame, alerts: DataFrame) -> DataFrame:
    """(row_no, text, source): what the registries know, as two blocks to put before the hits; an empty registry gives none.

    Registries are lists of report size: each becomes one text.
    """
    said = lambda part, column: F.coalesce(F.concat(F.lit(part), F.col(column)), F.lit(""))
    line = F.concat(F.lit("- "), "name", F.lit(": priority "), F.coalesce("priority", F.lit("medium")), said(", effective ", "effective_date"), said(" — ", "applicability"))
    alert = F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), "title", F.lit(" ("), "category", F.lit("): "), "summary", F.lit(" Required action: "), "action_required")
    parts = []
    for n, (rows, text, head, source) in enumerate(((regulations, line, "Tracked regulations, with their priority:", "regulatory registry"), (alerts, alert, "Active alerts:", "regulatory alerts"))):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))), lambda s: s["t"]), "\n")
        found = rows.agg(F.count(F.lit(1)).alias("n"), joined.alias("t")).where("n > 0")
        parts.append(found.select(F.lit(n).alias("row_no"), F.concat(F.lit(head + "\n"), "t").alias("text"), F.lit(source).alias("source")))
    return union_all(*parts)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of the registered queries: every point whose id is divisible by 100, as if it were an embedded question."""
    return view(spark, sf_dir, "v_points").where(F.col("point_id") % 100 == 0).select(F.col("point_id").alias("query_id"), "embedding")


SQL_SCORES = "q AS (SELECT point_id AS query_id, embedding AS q FROM v_points WHERE point_id % 100 = 0), s AS (SELECT query_id, point_id, collection, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM v_points, q)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6).cast("decimal(9,6)").cast("string"))


SQL_ROUNDED = "CAST(CAST(round(score, 6) AS DECIMAL(9,6)) AS VARCHAR) AS score"


@register("dense_topk", f"WITH {SQL_SCORES} SELECT query_id, point_id, collection, {SQL_ROUNDED}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, point_id) AS INTEGER) AS hit_rank FROM s QUALIFY hit_rank <= 5", ("v_points",))
def dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense_topk(view(spark, sf_dir, "v_points"), _queries(spark, sf_dir)))


@register("dense_topk_per_collection", f"WITH {SQL_SCORES} SELECT query_id, point_id, collection, {SQL_ROUNDED}, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY s.score DESC, point_id) AS INTEGER) AS hit_rank FROM s QUALIFY hit_rank <= 2", ("v_points",))
def dense_collections_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense_topk(view(spark, sf_dir, "v_points"), _queries(spark, sf_dir), 2, per_collection=True))


@register("multi_query_fusion", f"WITH {SQL_SCORES}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS hit_rank FROM s QUALIFY hit_rank <= 20), t AS (SELECT h.*, 'point ' || (point_id % 50) AS text FROM h WHERE score >= 0.2), f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY query_id, hit_rank) AS r FROM t QUALIFY r = 1) SELECT query_id, point_id, text, {SQL_ROUNDED} FROM f ORDER BY f.score DESC, query_id, hit_rank LIMIT 12", ("v_points",))
def fusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense_topk(view(spark, sf_dir, "v_points"), _queries(spark, sf_dir), 20).withColumn("text", F.concat(F.lit("point "), (F.col("point_id") % 50).cast("string")))
    return _rounded(multi_query_fusion(hits, "text", 0.2, 12)).select("query_id", "point_id", "text", "score")


QUESTION = "which license version applies to the thing"


@register("local_lexical_search", f"WITH s AS (SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')), ['{chr(39).join(QUESTION.split(' ')).replace(chr(39), chr(39) + ', ' + chr(39))}'])) AS BIGINT) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5")
def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), QUESTION, 5).select("doc_id", "score")


DIRECTORY_QUESTION = "is the apache license company listed"


@register("directory_lexical_search", """WITH s AS (SELECT doc_id, text, lower(text) AS l, CAST(contains(lower(text), 'apache') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) AS m FROM documents),
b AS (SELECT *, m + CASE WHEN contains(l, 'apache license company') THEN 5 ELSE 0 END AS score FROM s WHERE m > 0 ORDER BY score DESC, doc_id LIMIT 10),
p AS (SELECT *, greatest(CASE WHEN contains(l, 'apache license company') THEN instr(l, 'apache license company') ELSE instr(l, 'apache') END, 1) - 1 - 120 AS st FROM b)
SELECT doc_id, CASE WHEN st > 0 THEN '…' ELSE '' END || trim(substr(text, greatest(st, 0) + 1, 480)) || '…' AS text, least(0.99, round(0.5 + 0.08 * score, 2))::DOUBLE AS score FROM p""")
def directory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_search(table(spark, sf_dir, "documents").select("doc_id", "text"), DIRECTORY_QUESTION, 10)


@register("federated_search", f"""WITH {SQL_SCORES}, h AS (SELECT collection, point_id, score, 1 + CAST(substr(collection, 5) AS INTEGER) AS collection_no, CAST(row_number() OVER (PARTITION BY collection ORDER BY score DESC, point_id) AS INTEGER) AS hit_rank FROM s WHERE query_id = 0 QUALIFY hit_rank <= 2),
t AS (SELECT collection_no, hit_rank, 'point ' || (point_id % 50) AS text, score FROM h
UNION ALL SELECT 0, CAST(row_number() OVER (ORDER BY s.m DESC, doc_id) AS INTEGER), left(text, 300), least(0.99, 0.5 + 0.08 * s.m) FROM (SELECT doc_id, text, CAST(contains(lower(text), 'apache') AS INTEGER) AS m FROM documents) s WHERE m > 0 QUALIFY row_number() OVER (ORDER BY s.m DESC, doc_id) <= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY left(text, 300) ORDER BY collection_no, hit_rank) AS r FROM t QUALIFY r = 1) SELECT collection_no, hit_rank, text, {SQL_ROUNDED} FROM f ORDER BY f.score DESC, collection_no, hit_rank LIMIT 8""", ("v_points",))
def federated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = directory_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "apache", 2)
    lexical = lexical.select(F.lit(0).alias("collection_no"), "hit_rank", F.left("whole", F.lit(300)).alias("text"), "score")
    return _rounded(federated([_dense_hits(spark, sf_dir, _queries(spark, sf_dir).where("query_id = 0")).drop("query_id"), lexical], 8))


def _dense_hits(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    """Two hits of each query in each collection, as federated() takes them."""
    dense = dense_topk(view(spark, sf_dir, "v_points"), queries, 2, per_collection=True)
    return dense.select("query_id", (F.substring("collection", 5, 9).cast("int") + 1).alias("collection_no"), "hit_rank", F.concat(F.lit("point "), (F.col("point_id") % 50).cast("string")).alias("text"), "score")


@register("federated_search_all", f"""WITH {SQL_SCORES}, h AS (SELECT query_id, point_id, score, 1 + CAST(substr(collection, 5) AS INTEGER) AS collection_no, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, point_id) AS INTEGER) AS hit_rank FROM s QUALIFY hit_rank <= 2),
l AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS hit_rank, text, score FROM ({ORACLES["directory_lexical_search"]}) d QUALIFY hit_rank <= 2),
t AS (SELECT query_id, collection_no, hit_rank, 'point ' || (point_id % 50) AS text, score FROM h UNION ALL SELECT query_id, 0, hit_rank, text, score FROM l, (SELECT query_id FROM q) q),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 300) ORDER BY collection_no, hit_rank) AS r FROM t QUALIFY r = 1) SELECT query_id, collection_no, hit_rank, text, {SQL_ROUNDED} FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, collection_no, hit_rank) <= 8""", ("v_points",))
def federated_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """federated_search of every query, with the directory search's own hits."""
    queries = _queries(spark, sf_dir)
    lexical = directory_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), DIRECTORY_QUESTION, 2)
    lexical = queries.select("query_id").crossJoin(F.broadcast(lexical.select(F.lit(0).alias("collection_no"), "hit_rank", "text", "score")))
    return _rounded(federated([_dense_hits(spark, sf_dir, queries), lexical], 8, ["query_id"]))


@register("context_budget", """WITH b AS (SELECT source, doc_id, '[' || source || ']' || chr(10) || text AS block FROM documents), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT source, count(*) AS blocks, md5(string_agg(block, chr(10) || chr(10) ORDER BY doc_id)) AS context FROM u WHERE used <= 9000 GROUP BY source""")
def context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"], 9000, F.asc("doc_id"), key="doc_id").withColumn("context", F.md5("context"))


#: A selection in order, with one collection that the registry doesn't know.
SELECTED = ("col_7", "col_2", "col_99", "col_5")


@register("policy_chunks", f"WITH {SQL_SCORES}, c(collection, selection_no) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(SELECTED))}), k AS (SELECT c.* FROM c WHERE collection IN (SELECT 'col_' || n_nationkey FROM nation)) SELECT query_id, selection_no, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY s.score DESC, point_id) AS INTEGER) AS hit_rank, collection, point_id, {SQL_ROUNDED} FROM s JOIN k USING (collection) QUALIFY hit_rank <= 3", ("v_points",))
def policy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = spark.createDataFrame([(c, i) for i, c in enumerate(SELECTED)], "collection string, selection_no int")
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("col_"), F.col("n_nationkey").cast("string")).alias("collection"))
    return _rounded(policy_chunks(view(spark, sf_dir, "v_points"), _queries(spark, sf_dir), selected, registry))


@register("landscape_chunks", f"WITH {SQL_SCORES}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, point_id) AS hit_rank FROM s QUALIFY hit_rank <= 2), t AS (SELECT h.*, 'point ' || (point_id % 50) AS text FROM h WHERE score >= 0.45), o AS (SELECT *, row_number() OVER (PARTITION BY collection, text ORDER BY query_id, hit_rank) AS f FROM t QUALIFY f = 1), p AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, point_id) AS n FROM o QUALIFY n <= 3) SELECT collection, point_id, query_id, text, {SQL_ROUNDED} FROM p ORDER BY p.score DESC, collection, point_id LIMIT 14", ("v_points",))
def landscape_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "v_points")
    texts = points.select("point_id", F.concat(F.lit("point "), (F.col("point_id") % 50).cast("string")).alias("text"))
    return _rounded(landscape_chunks(points, _queries(spark, sf_dir), texts))


@register("registry_context", """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'high' ELSE 'medium' END AS severity, p_name AS title, p_brand AS category, p_type AS summary, 'Check ' || p_name AS action_required FROM part WHERE p_size > 48),
r AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey > 2 THEN 'high' END AS priority, CASE WHEN n_nationkey % 2 = 0 THEN '2026-01-01' END AS effective_date, CASE WHEN n_nationkey % 3 = 0 THEN 'all lenders' END AS applicability FROM nation)
SELECT 0 AS row_no, 'Tracked regulations, with their priority:' || chr(10) || string_agg('- ' || name || ': priority ' || coalesce(priority, 'medium') || coalesce(', effective ' || effective_date, '') || coalesce(' — ' || applicability, ''), chr(10) ORDER BY id) AS text, 'regulatory registry' AS source FROM r HAVING count(*) > 0
UNION ALL SELECT 1, 'Active alerts:' || chr(10) || string_agg('- [' || upper(severity) || '] ' || title || ' (' || category || '): ' || summary || ' Required action: ' || action_required, chr(10) ORDER BY id), 'regulatory alerts' FROM a HAVING count(*) > 0""")
def registry_context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    regulations = table(spark, sf_dir, "nation").select(key.alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 2, "high").alias("priority"), F.when(key % 2 == 0, "2026-01-01").alias("effective_date"), F.when(key % 3 == 0, "all lenders").alias("applicability"))
    alerts = table(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "high").otherwise("medium").alias("severity"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_type").alias("summary"), F.concat(F.lit("Check "), "p_name").alias("action_required"))
    return registry_context(regulations, alerts)
