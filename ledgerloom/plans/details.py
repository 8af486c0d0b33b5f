"""Smaller lookups of the console: branch attributes, selections with a default, counts, filters, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lending as L
from ledgerloom.functions import periods
from ledgerloom.operators.relational import percent, with_default
from ledgerloom.plans import portfolio as P
from ledgerloom.plans import returns as R
from ledgerloom.plans import state as S
from ledgerloom.plans.domain import table, view
from ledgerloom.plans.registry import register, sql_lakhs, sql_percent

#: Attributes by branch code of the registered queries (name, manager, city); the caller brings its own relation.
BRANCHES = tuple((str(i + 1), name, f"Lead - {name}", f"{name} City") for i, name in enumerate(("North", "East", "South", "West", "Coast", "Hills", "Plains", "Delta")))


def branch_attributes(codes: DataFrame, attributes: DataFrame, code: str = "code") -> DataFrame:
    """``codes`` with name, manager and city: the code's own attributes, else those at the code modulo their number (a text code by its crc32), marked with the code.

    ``attributes`` (code, name, maybe manager and city) is a small relation and
    keeps its order by code; a null code is 1.
    """
    n = attributes.count()
    kept = [c for c in ("name", "manager", "city") if c in attributes.columns]
    ranked = attributes.select(F.col("code").alias("_code"), *[F.col(c).alias(f"_{c}") for c in kept], (F.row_number().over(Window.orderBy("code")) - 1).alias("_slot"))
    plain = F.coalesce(L.plain_code(F.col(code)), F.lit("1"))
    number = F.coalesce(plain.try_cast("long"), F.crc32(plain.cast("binary")))
    rows = codes.withColumn("_plain", plain).withColumn("_at", F.pmod(number, F.lit(n)))
    exact = rows.join(ranked.select(F.col("_code").alias("_own"), *[F.col(f"_{c}").alias(f"_own_{c}") for c in kept]), F.col("_plain") == F.col("_own"), "left")
    both = exact.join(ranked.drop("_code"), F.col("_at") == F.col("_slot"), "left")
    marked = {"name": F.concat("_name", F.lit(" (Code #"), "_plain", F.lit(")")), "manager": F.concat(F.lit("Lead #"), "_plain"), "city": F.col("_city") if "city" in kept else None}
    for c in kept:
        both = both.withColumn(c, F.when(F.col("_own").isNotNull(), F.col(f"_own_{c}")).otherwise(marked[c]))
    return both.select(*codes.columns, *kept)


SQL_BRANCHES = f"a(code, name) AS (VALUES {', '.join(f"('{c}', '{n}')" for c, n, *_ in BRANCHES)}), k AS (SELECT name, row_number() OVER (ORDER BY code) - 1 AS slot FROM a)"


@register("branch_attributes", f"""WITH {SQL_BRANCHES}, b AS (SELECT DISTINCT brn_code AS code, CAST(brn_code AS VARCHAR) AS p FROM v_loans)
SELECT b.code, coalesce(a.name, k.name || ' (Code #' || p || ')') AS name FROM b LEFT JOIN a ON p = a.code LEFT JOIN k ON b.code % 8 = slot""", ("v_loans",))
def branch_attributes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_attributes(spark, view(spark, sf_dir, "v_loans").select(F.col("brn_code").alias("code")).distinct()).select("code", "name")


def _with_attributes(spark: SparkSession, codes: DataFrame, code: str = "code") -> DataFrame:
    return branch_attributes(codes, spark.createDataFrame(list(BRANCHES), "code string, name string, manager string, city string"), code)


@register("branch_directory", f"""WITH {SQL_BRANCHES}, b AS (SELECT brn_code AS code, CAST(brn_code AS VARCHAR) AS p, {P.SQL_MEASURES} FROM v_loans WHERE brn_code IS NOT NULL GROUP BY brn_code)
SELECT b.* EXCLUDE (p), coalesce(a.name, k.name || ' (Code #' || p || ')') AS name, coalesce('Lead - ' || a.name, 'Lead #' || p) AS manager, coalesce(a.name, k.name) || ' City' AS city FROM b LEFT JOIN a ON p = a.code LEFT JOIN k ON b.code % 8 = slot""", ("v_loans",))
def directory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches with their measures, names, managers and cities."""
    return _with_attributes(spark, P.by(view(spark, sf_dir, "v_loans"), "brn_code", "code"))


@register("annex13_named", f"""WITH {SQL_BRANCHES}, b AS (SELECT CAST(brn_code AS BIGINT) AS branch_code, count(DISTINCT cust_id) AS customer_count, count(*) AS account_count, {sql_lakhs(f'sum({R.OUTSTANDING})')} AS total_outstanding FROM v_loans WHERE brn_code IS NOT NULL AND {R.IN_BOOK} GROUP BY brn_code)
SELECT branch_code, coalesce(a.name, k.name || ' (Code #' || branch_code || ')') || ' Virtual Branch' AS branch_name, customer_count, account_count, total_outstanding FROM b LEFT JOIN a ON CAST(branch_code AS VARCHAR) = a.code LEFT JOIN k ON branch_code % 8 = slot""", ("v_loans",))
def annex13_named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex13_named(spark, view(spark, sf_dir, "v_loans"), R.AS_OF)


def annex13_named(spark: SparkSession, loans: DataFrame, as_of: str) -> DataFrame:
    """Annex 13 with the branches' names."""
    named = _with_attributes(spark, R.annex13(loans, as_of), "branch_code")
    return named.select("branch_code", F.concat("name", F.lit(" Virtual Branch")).alias("branch_name"), "customer_count", "account_count", "total_outstanding")


def selected_month(series: DataFrame, month: str) -> DataFrame:
    """The month's row of a monthly series, or the newest where it is unknown."""
    return with_default(series, F.col("month") == month, F.desc("month"))


@register("selected_month_metrics", "SELECT strftime(sanc_date, '%Y-%m') AS month, count(*) AS loan_count, count(DISTINCT cust_id) AS cust_count FROM v_loans WHERE sanc_date IS NOT NULL GROUP BY 1 ORDER BY month = '2031-01' DESC, month DESC LIMIT 1", ("v_loans",))
def selected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected_month(P.monthly(view(spark, sf_dir, "v_loans")), "2031-01").select("month", "loan_count", "cust_count")


def branches_of(divisions: DataFrame, zone: str, most: int = 4) -> DataFrame:
    """A division's branches, or the first few of all where it has none."""
    own = (F.col("zone_id") == zone).cast("int")
    marked = divisions.withColumn("_own", own).withColumn("_any", F.max(own).over(Window.partitionBy())).withColumn("_n", F.row_number().over(Window.orderBy("branch_code")))
    return marked.where(((F.col("_any") == 1) & (F.col("_own") == 1)) | ((F.col("_any") == 0) & (F.col("_n") <= most))).drop("_own", "_any", "_n")


@register("division_branches", f"WITH {P.SQL_DIVISIONS} SELECT brn_code AS branch_code, zone_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d WHERE zone_id = 'ZONE-PROD-99') QUALIFY row_number() OVER (ORDER BY brn_code) <= 4", ("v_loans",))
def branches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches_of(P.branch_divisions(view(spark, sf_dir, "v_loans")), "ZONE-PROD-99").select("branch_code", "zone_id")


def scheme_desk(loans: DataFrame, branch: str) -> DataFrame:
    """The branch's top schemes with titles, and each one's share of the rows shown."""
    rows = P.schemes_of(loans, branch)
    total = F.sum(F.col("total_vol").cast("decimal(24,2)")).over(Window.partitionBy())
    return rows.select("code", L.scheme_title(F.col("code")).alias("title"), "acnt_count", percent(F.col("total_vol").cast("decimal(24,2)"), total).alias("share_pct"), F.format_number("acnt_count", 0).alias("shown"))


@register("scheme_desk", f"""WITH s AS (SELECT schm_code AS code, count(*) AS acnt_count, sum({P.DISB}) AS v FROM v_loans WHERE CAST(brn_code AS VARCHAR) = '7' AND schm_code IS NOT NULL GROUP BY 1 ORDER BY acnt_count DESC, code LIMIT 5)
SELECT code, CASE WHEN code LIKE '1%' THEN 'Gold Loan Desk (Scheme #' || code || ')' ELSE 'Lending Scheme Desk #' || code END AS title, acnt_count, {sql_percent('v', '(SELECT sum(v) FROM s)')} AS share_pct, format('{{:,}}', acnt_count) AS shown FROM s""", ("v_loans",))
def desk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme_desk(view(spark, sf_dir, "v_loans"), "7")


@register("review_status_counts", f"WITH {S.SQL_REVIEWS} SELECT status, count(*) AS items FROM q GROUP BY status", ("v_review_log",))
def status_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.review_queue(S._items(spark, sf_dir), view(spark, sf_dir, "v_review_log")).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def matching(registry: DataFrame, name: str, kind: Column) -> DataFrame:
    """Registry rows of a kind whose name contains a text, whatever its case; a blank text matches all."""
    return registry.where(F.lower("name").contains(name.strip().lower()) & kind)


@register("registry_filter", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'bank' ELSE 'other' END AS kind FROM supplier WHERE contains(lower(s_name), '00001') AND s_acctbal > 0")
def registry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "bank").otherwise("other").alias("kind"))
    return matching(rows, " 00001", F.col("kind") == "bank")


@register("event_age_labels", "WITH e AS (SELECT event_id, epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS age FROM e")
def ages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", periods.age_label(then, F.lit(S.NOW).cast("timestamp")).alias("age"))


@register("event_fields", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), '#') AS page, len(json_keys(props)) AS n_fields FROM events")
def fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields with two defaults."""
    fields = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(fields, F.lit("page")), F.try_element_at(fields, F.lit("k")), F.lit("#")).alias("page"), F.size(F.json_object_keys("props")).cast("long").alias("n_fields"))


def totals_or_parts(total: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """The one row of ``total``, each of whose columns that is 0 or missing takes the sum over ``parts``."""
    sums = parts.agg(*[F.sum(c).alias(f"_{c}") for c in columns]).withColumn("_k", F.lit(1))
    both = total.withColumn("_k", F.lit(1)).join(sums, "_k")
    return both.select(*[F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


@register("totals_or_branches", f"WITH t AS (SELECT count(*) AS acnt_count, CAST(coalesce(sum({P.DISB}), 0) AS DOUBLE) AS total_vol FROM v_loans WHERE prod_code = -1), b AS (SELECT count(*) AS acnt_count, CAST(sum({P.DISB}) AS DOUBLE) AS total_vol FROM v_loans WHERE brn_code IS NOT NULL) SELECT CASE WHEN t.acnt_count = 0 THEN b.acnt_count ELSE t.acnt_count END AS acnt_count, CASE WHEN t.total_vol = 0 THEN b.total_vol ELSE t.total_vol END AS total_vol FROM t, b", ("v_loans",))
def totals_or_branches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a book that is empty, taken from its branches."""
    loans = view(spark, sf_dir, "v_loans")
    return totals_or_parts(P.totals(loans.where("prod_code = -1")), P.by(loans, "brn_code", "code"), ["acnt_count", "total_vol"])


def overlay(base: Column, over: Column) -> Column:
    """Two maps as one; the second's entries win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(over, k), F.lit(False))), over)


@register("event_overlay", "SELECT event_id, 'view' AS kind, coalesce(json_extract_string(props, '$.k'), 'none') AS k, len(list_distinct(list_concat(json_keys(props), ['kind', 'seen']))) AS n_fields FROM events")
def overlay_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload fields under the stored ones."""
    base = F.create_map(F.lit("kind"), F.lit("none"), F.lit("k"), F.lit("none"))
    fields = overlay(overlay(F.map_filter(base, lambda k, _: k != "k"), F.from_json("props", "map<string,string>")), F.create_map(F.lit("kind"), F.lit("view"), F.lit("seen"), F.lit("1")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(fields, F.lit("kind")).alias("kind"), F.coalesce(F.try_element_at(fields, F.lit("k")), F.lit("none")).alias("k"), F.size(fields).cast("long").alias("n_fields"))


def with_category_urls(alerts: DataFrame, categories: DataFrame, default: str = "#") -> DataFrame:
    """Alerts with their category's url, or the default."""
    return alerts.join(categories.select("category", F.col("url").alias("source_url")), "category", "left").withColumn("source_url", F.coalesce("source_url", F.lit(default)))


@register("alert_urls", "SELECT p_partkey AS id, p_brand AS category, coalesce('https://rules.example/' || n_nationkey, '#') AS source_url FROM part LEFT JOIN nation ON p_brand = 'Brand#' || n_nationkey")
def alert_urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"))
    key = F.col("n_nationkey").cast("string")
    categories = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), key).alias("category"), F.concat(F.lit("https://rules.example/"), key).alias("url"))
    return with_category_urls(alerts, categories).select("id", "category", "source_url")


def with_applicability(institutions: DataFrame, texts: DataFrame, default: str) -> DataFrame:
    """Institutions with the text of their category, or the default."""
    return institutions.join(texts, "category", "left").withColumn("applicability", F.coalesce("applicability", F.lit(default)))


@register("institution_applicability", "SELECT c_custkey AS id, c_mktsegment AS category, CASE c_mktsegment WHEN 'BUILDING' THEN 'Term lending' WHEN 'MACHINERY' THEN 'Equipment finance' ELSE 'General lending' END AS applicability FROM customer")
def applicability_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("BUILDING", "Term lending"), ("MACHINERY", "Equipment finance")], "category string, applicability string")
    return with_applicability(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category")), texts, "General lending").select("id", "category", "applicability")


@register("registry_counts", "SELECT (SELECT count(*) FROM supplier) AS institutions, (SELECT count(*) FROM nation) AS regulations")
def registry_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_counts(institutions=table(spark, sf_dir, "supplier"), regulations=table(spark, sf_dir, "nation"))


def registry_counts(**registries: DataFrame) -> DataFrame:
    """One row with the number of entries of each registry."""
    parts = [r.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1)) for name, r in registries.items()]
    return reduce(lambda a, b: a.join(b, "_k"), parts).drop("_k")


def institution_list(registry: DataFrame) -> DataFrame:
    """The list's columns of an institution registry; an unknown focus counts as one."""
    return registry.select("id", "name", "type", "headquarters", F.coalesce("msme_focus", F.lit(True)).alias("msme_focus"), "website", "qdrant_collection")


@register("institution_list", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'bank' ELSE 'other' END AS type, n_name AS headquarters, CASE WHEN s_suppkey % 3 = 0 THEN TRUE ELSE s_suppkey % 3 = 1 END AS msme_focus, 'https://s.example/' || s_suppkey AS website, 'comp_' || s_suppkey AS qdrant_collection FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def institution_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("headquarters"))
    rows = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left").withColumn("msme_focus", F.when(key % 3 != 0, key % 3 == 1))
    return institution_list(rows.select(key.alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "bank").otherwise("other").alias("type"), "headquarters", "msme_focus", F.concat(F.lit("https://s.example/"), key.cast("string")).alias("website"), F.concat(F.lit("comp_"), key.cast("string")).alias("qdrant_collection"), "s_acctbal"))
