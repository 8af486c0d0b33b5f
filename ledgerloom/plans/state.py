"""Small keyed state: a TTL cache, a review queue, feeds and collection status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.relational import first_seen, top_k, union_all, upsert_latest
from ledgerloom.plans.domain import table, view
from ledgerloom.plans.registry import register

NOW = "2024-01-30 00:00:00"
MODULES = {"click": "Macro", "view": "Competitive", "purchase": "Regulatory", "signup": "Policy"}


def cache_state(log: DataFrame) -> DataFrame:
    """The cache after all writes: each key's last payload."""
    return upsert_latest(log, "cache_key", F.col("generated_at"), F.col("seq"))


def cache_lookup(state: DataFrame, now: str, ttl_hours: int = 12, prefix: str = "v3:") -> DataFrame:
    """Entries of this version not older than the time to live."""
    fresh = F.col("generated_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    return state.where(F.col("cache_key").startswith(prefix) & fresh)


SQL_CACHE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY generated_at DESC, seq DESC) AS r FROM v_brief_log) WHERE r = 1)"


@register("cache_upsert_latest", f"WITH {SQL_CACHE} SELECT cache_key, seq, md5(payload) AS payload FROM c", ("v_brief_log",))
def cache_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_state(view(spark, sf_dir, "v_brief_log")).select("cache_key", "seq", F.md5("payload").alias("payload"))


@register("cache_lookup_ttl", f"WITH {SQL_CACHE} SELECT cache_key, seq FROM c WHERE cache_key LIKE 'v3:%' AND generated_at >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR", ("v_brief_log",))
def lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_lookup(cache_state(view(spark, sf_dir, "v_brief_log")), NOW).select("cache_key", "seq")


def resolved(state: DataFrame, names: DataFrame) -> DataFrame:
    """Cache keys as feed items: ``ask`` keys go; the title is the registry's name, else the key's own part."""
    parts = F.split("cache_key", ":")
    kind, own = F.element_at(parts, 2), F.element_at(parts, 3)
    items = state.withColumn("_kind", kind).withColumn("_own", own).where(kind != "ask")
    title = F.coalesce(F.col("name"), F.col("_own"))
    module = F.create_map(*[F.lit(x) for pair in MODULES.items() for x in pair])[F.col("_kind")]
    return items.join(names, F.col("_own") == F.col("name_id"), "left").withColumn("title", title).withColumn("module", module).where(F.col("module").isNotNull())


def recent(state: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """The newest items, each title once, among the newest three times ``limit`` entries."""
    newest = top_k(state, limit * 3, F.desc("generated_at"), F.desc("seq"))
    once = first_seen(resolved(newest, names), ["title"], F.desc("generated_at"), F.desc("seq"))
    return top_k(once, limit, F.desc("generated_at"), F.desc("seq")).select("title", "module", "generated_at")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name_id"), F.col("n_name").alias("name"))


@register("recent_feed", f"""WITH {SQL_CACHE}, n AS (SELECT * FROM c ORDER BY generated_at DESC, seq DESC LIMIT 15), i AS (SELECT *, split_part(cache_key, ':', 2) AS kind, split_part(cache_key, ':', 3) AS own FROM n),
t AS (SELECT i.*, coalesce(n_name, own) AS title, CASE kind WHEN 'click' THEN 'Macro' WHEN 'view' THEN 'Competitive' WHEN 'purchase' THEN 'Regulatory' WHEN 'signup' THEN 'Policy' END AS module FROM i LEFT JOIN nation k ON own = CAST(n_nationkey AS VARCHAR) WHERE kind <> 'ask'),
o AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY generated_at DESC, seq DESC) AS f FROM t WHERE module IS NOT NULL QUALIFY f = 1) SELECT title, module, CAST(epoch_us(generated_at) // 1000000 AS BIGINT) AS generated_at FROM o ORDER BY generated_at DESC LIMIT 5""", ("v_brief_log",))
def recent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recent(cache_state(view(spark, sf_dir, "v_brief_log")), _names(spark, sf_dir))
    return found.withColumn("generated_at", F.floor(F.unix_micros(F.col("generated_at").cast("timestamp")) / 1_000_000).cast("long"))


def review_queue(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with their last review, or pending."""
    last = upsert_latest(log, "item_id", F.col("reviewed_at"), F.col("seq")).select("item_id", "status", "note")
    return items.join(last, "item_id", "left").withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("note", F.coalesce("note", F.lit("")))


SQL_REVIEWS = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY reviewed_at DESC, seq DESC) AS n FROM v_review_log) WHERE n = 1), q AS (SELECT c_custkey AS item_id, c_name AS title, coalesce(status, 'pending') AS status, coalesce(note, '') AS note FROM customer LEFT JOIN r ON item_id = c_custkey)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"))


@register("review_queue", f"WITH {SQL_REVIEWS} SELECT * FROM q", ("v_review_log",))
def reviews_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(_items(spark, sf_dir), view(spark, sf_dir, "v_review_log"))


def action_items(queue: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flagged items and alerts of high severity."""
    flagged = queue.where("status = 'flagged'").select("title", F.coalesce(F.nullif("note", F.lit("")), F.lit("Flagged during review.")).alias("detail"), F.lit("/review").alias("href"))
    high = alerts.where("severity = 'high'").select(F.col("action_required").alias("title"), F.col("category").alias("detail"), F.lit("/regulatory").alias("href"))
    return union_all(flagged, high).withColumn("priority", F.lit("High"))


@register("action_items", f"WITH {SQL_REVIEWS} SELECT title, coalesce(nullif(note, ''), 'Flagged during review.') AS detail, '/review' AS href, 'High' AS priority FROM q WHERE status = 'flagged' UNION ALL SELECT 'Check ' || p_name, p_brand, '/regulatory', 'High' FROM part WHERE p_size > 40", ("v_review_log",))
def actions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 40, "high").otherwise("medium").alias("severity"), F.concat(F.lit("Check "), "p_name").alias("action_required"), F.col("p_brand").alias("category"))
    return action_items(review_queue(_items(spark, sf_dir), view(spark, sf_dir, "v_review_log")), alerts)


def collection_status(registry: DataFrame, points: DataFrame) -> DataFrame:
    """Each registered collection with its number of points; null and not indexed where there is none."""
    counts = points.groupBy("collection").agg(F.count(F.lit(1)).alias("vectors"))
    return registry.join(counts, "collection", "left").withColumn("indexed", F.col("vectors").isNotNull())


@register("collection_status", "WITH k AS (SELECT collection, count(*) AS vectors FROM v_points GROUP BY 1), g AS (SELECT 'col_' || n_nationkey AS collection, n_name AS name FROM nation) SELECT g.collection, name, vectors, vectors IS NOT NULL AS indexed FROM g LEFT JOIN k ON g.collection = k.collection", ("v_points",))
def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("col_"), F.col("n_nationkey").cast("string")).alias("collection"), F.col("n_name").alias("name"))
    return collection_status(registry, view(spark, sf_dir, "v_points"))


def existing_collections(registry: DataFrame, points: DataFrame) -> DataFrame:
    """Registered collections that have points."""
    return registry.join(points.select("collection").distinct(), "collection", "left_semi")


@register("existing_collections", "SELECT 'col_' || n_nationkey AS collection, n_name AS name FROM nation WHERE 'col_' || n_nationkey IN (SELECT collection FROM v_points)", ("v_points",))
def existing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").select(F.concat(F.lit("col_"), F.col("n_nationkey").cast("string")).alias("collection"), F.col("n_name").alias("name"))
    return existing_collections(registry, view(spark, sf_dir, "v_points"))


def review_items(static: DataFrame, institutions: DataFrame, regulations: DataFrame) -> DataFrame:
    """(id, title, module): fixed items (of those columns), then institutions and regulations (id, name) under their own prefix."""
    competitive = institutions.select(F.concat(F.lit("competitive:"), F.col("id").cast("string")).alias("id"), F.concat("name", F.lit(" — profile & SWOT")).alias("title"), F.lit("Competitive").alias("module"))
    regulatory = regulations.select(F.concat(F.lit("regulatory:"), F.col("id").cast("string")).alias("id"), F.col("name").alias("title"), F.lit("Regulatory").alias("module"))
    return union_all(static.select("id", "title", "module"), competitive, regulatory)


STATIC_ITEMS = (("macro:brief", "Macro brief", "Macro"), ("policy:draft", "Policy draft", "Policy"))


@register("review_items", "SELECT * FROM (VALUES ('macro:brief', 'Macro brief', 'Macro'), ('policy:draft', 'Policy draft', 'Policy')) t(id, title, module) UNION ALL SELECT 'competitive:' || s_suppkey, s_name || ' — profile & SWOT', 'Competitive' FROM supplier UNION ALL SELECT 'regulatory:' || n_nationkey, n_name, 'Regulatory' FROM nation")
def review_items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    institutions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    regulations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return review_items(spark.createDataFrame(list(STATIC_ITEMS), "id string, title string, module string"), institutions, regulations)


def all_collections(macro: str, institutions: DataFrame, regulations: DataFrame) -> DataFrame:
    """(place, collection, label, module) of every configured collection: the macro one, then institutions and regulations (id, collection, name) by id."""
    spark = institutions.sparkSession
    first = spark.createDataFrame([(0, "", macro, "Macro-economic Intelligence", "Macro")], "part int, id string, collection string, label string, module string")
    parts = [d.select(F.lit(i).alias("part"), F.col("id").cast("string").alias("id"), "collection", F.col("name").alias("label"), F.lit(m).alias("module")) for i, (d, m) in enumerate(((institutions, "Competitive"), (regulations, "Regulatory")), 1)]
    whole = union_all(first, *parts)  # registries: a row a collection
    return whole.withColumn("place", F.row_number().over(Window.orderBy("part", "id"))).select("place", "collection", "label", "module")


@register("all_collections", "WITH u AS (SELECT 0 AS part, '' AS id, 'macro' AS collection, 'Macro-economic Intelligence' AS label, 'Macro' AS module UNION ALL SELECT 1, CAST(s_suppkey AS VARCHAR), 'comp_' || s_suppkey, s_name, 'Competitive' FROM supplier UNION ALL SELECT 2, CAST(n_nationkey AS VARCHAR), 'reg_' || n_nationkey, n_name, 'Regulatory' FROM nation) SELECT CAST(row_number() OVER (ORDER BY part, id) AS INTEGER) AS place, collection, label, module FROM u")
def all_collections_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, k, n, prefix: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.concat(F.lit(prefix), F.col(k).cast("string")).alias("collection"), F.col(n).alias("name"))
    return all_collections("macro", named("supplier", "s_suppkey", "s_name", "comp_"), named("nation", "n_nationkey", "n_name", "reg_"))
