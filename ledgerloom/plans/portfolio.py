"""Loan-book drill-down: totals, by product, branch, scheme and customer, monthly series, cohorts, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lending as L
from ledgerloom.operators.relational import first_seen, growth, percent, round_robin, top_k, top_k_per_group, union_all
from ledgerloom.plans.domain import table, view
from ledgerloom.plans.registry import register, sql_percent

DISB = "coalesce(nullif(lndisb_amt, 0), sanc_amt)"
PRODUCTS = ((16, "msme_count"), (13, "mfi_count"), (1, "gold_count"))


def measured(loans: DataFrame) -> DataFrame:
    """Loans with the drill-down's disbursed and repaid amounts."""
    return loans.withColumn("_disb", L.disbursed(F.col("lndisb_amt"), F.col("sanc_amt"), zero_is_missing=True)).withColumn("_rep", F.coalesce("pri_repay_amt", F.lit(0)))


def measures() -> list:
    return [F.count_distinct("cust_id").alias("cust_count"), F.count(F.lit(1)).alias("acnt_count"), F.coalesce(F.sum("_disb"), F.lit(0)).cast("double").alias("total_vol"), F.coalesce(F.sum("_rep"), F.lit(0)).cast("double").alias("repay_vol"), percent(F.coalesce(F.sum("_rep"), F.lit(0)), F.sum("_disb")).alias("eff_pct")]


SQL_MEASURES = f"count(DISTINCT cust_id) AS cust_count, count(*) AS acnt_count, CAST(coalesce(sum({DISB}), 0) AS DOUBLE) AS total_vol, CAST(coalesce(sum(pri_repay_amt), 0) AS DOUBLE) AS repay_vol, {sql_percent('coalesce(sum(pri_repay_amt), 0)', f'sum({DISB})')} AS eff_pct"


def totals(loans: DataFrame, month: str | None = None) -> DataFrame:
    """Totals of the book, or of one month's loans."""
    rows = loans if month is None else loans.where(L.in_month(F.col("sanc_date"), month))
    return measured(rows).agg(*measures())


@register("exec_totals", f"SELECT {SQL_MEASURES} FROM v_loans", ("v_loans",))
def totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(view(spark, sf_dir, "v_loans"))


@register("exec_totals_month", f"SELECT {SQL_MEASURES} FROM v_loans WHERE strftime(sanc_date, '%Y-%m') = '1998-05'", ("v_loans",))
def totals_month_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(view(spark, sf_dir, "v_loans"), "1998-05")


def by(loans: DataFrame, key: str, name: str) -> DataFrame:
    return measured(loans.where(F.col(key).isNotNull())).groupBy(F.col(key).alias(name)).agg(*measures())


@register("by_product", f"SELECT prod_code AS code, {SQL_MEASURES} FROM v_loans WHERE prod_code IS NOT NULL GROUP BY prod_code", ("v_loans",))
def by_product_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by(view(spark, sf_dir, "v_loans"), "prod_code", "code")


@register("by_branch", f"SELECT brn_code AS code, {SQL_MEASURES} FROM v_loans WHERE brn_code IS NOT NULL GROUP BY brn_code", ("v_loans",))
def by_branch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by(view(spark, sf_dir, "v_loans"), "brn_code", "code")


def drill_down(loans: DataFrame) -> DataFrame:
    """All levels of the drill-down in one pass: product, branch, scheme and their subtotals."""
    rolled = measured(loans).rollup("prod_code", "brn_code", "schm_code")
    return rolled.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("acnt_count"), F.sum("_disb").cast("double").alias("total_vol"))


@register("drill_down_rollup", f"SELECT prod_code, brn_code, schm_code, CAST(grouping(prod_code, brn_code, schm_code) AS INTEGER) AS level, count(*) AS acnt_count, CAST(sum({DISB}) AS DOUBLE) AS total_vol FROM v_loans GROUP BY ROLLUP (prod_code, brn_code, schm_code)", ("v_loans",))
def drill_down_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drill_down(view(spark, sf_dir, "v_loans"))


def schemes_of(loans: DataFrame, branch: str, k: int = 5) -> DataFrame:
    rows = loans.where((L.plain_code(F.col("brn_code")) == branch) & F.col("schm_code").isNotNull())
    return top_k(by(rows, "schm_code", "code"), k, F.desc("acnt_count"), F.asc("code"))


@register("top_schemes_in_branch", f"SELECT schm_code AS code, {SQL_MEASURES} FROM v_loans WHERE CAST(brn_code AS VARCHAR) = '7' AND schm_code IS NOT NULL GROUP BY 1 ORDER BY acnt_count DESC, code LIMIT 5", ("v_loans",))
def schemes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemes_of(view(spark, sf_dir, "v_loans"), "7")


def customers_of(loans: DataFrame, customers: DataFrame, branch: str, k: int = 40) -> DataFrame:
    """Customers of the branches whose code contains ``branch``, by sanctioned amount."""
    rows = measured(loans.where(F.col("brn_code").cast("string").contains(branch))).join(customers, "cust_id", "left")
    name = L.borrower_name(F.col("cust_name"), [F.col("first_name"), F.col("middle_name"), F.col("last_name")], F.col("cust_id"))
    found = rows.groupBy("cust_id", name.alias("name")).agg(F.max("acnt_num").alias("acnt_num"), F.sum("_disb").cast("double").alias("total_vol"), F.max("sanc_date").alias("last_date"), F.sum("_rep").cast("double").alias("repay_vol"), F.sum("sanc_amt").alias("_sanc"))
    return top_k(found, k, F.desc("_sanc"), F.asc("cust_id")).drop("_sanc")


SQL_NAME = "coalesce(nullif(trim(cust_name), ''), nullif(trim(concat_ws(' ', first_name, middle_name, last_name)), ''), 'Borrower #' || CAST(cust_id AS VARCHAR))"


@register("branch_customers", f"WITH l AS MATERIALIZED (SELECT * FROM v_loans WHERE CAST(brn_code AS VARCHAR) LIKE '%1%'), c AS MATERIALIZED (SELECT * FROM v_customers), n AS MATERIALIZED (SELECT l.*, {SQL_NAME.replace('cust_id', 'l.cust_id')} AS name FROM l LEFT JOIN c ON l.cust_id = c.cust_id) SELECT cust_id, name, max(acnt_num) AS acnt_num, CAST(sum({DISB}) AS DOUBLE) AS total_vol, max(sanc_date) AS last_date, CAST(sum(coalesce(pri_repay_amt, 0)) AS DOUBLE) AS repay_vol FROM n GROUP BY 1, 2 ORDER BY sum(sanc_amt) DESC, cust_id LIMIT 40", ("v_loans", "v_customers"))
def customers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_of(view(spark, sf_dir, "v_loans"), view(spark, sf_dir, "v_customers"), "1")


def account_of(loans: DataFrame, customers: DataFrame, cust_id: str) -> DataFrame:
    """A customer's accounts."""
    rows = measured(loans.where(F.col("cust_id").cast("string") == cust_id)).join(customers, "cust_id", "left")
    name = L.borrower_name(F.col("cust_name"), [F.col("first_name"), F.col("middle_name"), F.col("last_name")], F.col("cust_id"))
    return rows.select("acnt_num", "cust_id", name.alias("name"), F.col("_disb").cast("double").alias("disbursed"), F.col("_rep").cast("double").alias("repaid"), percent(F.col("_rep"), F.col("_disb")).alias("eff_pct"))


@register("customer_account", f"SELECT acnt_num, cust_id, {SQL_NAME} AS name, CAST({DISB} AS DOUBLE) AS disbursed, CAST(coalesce(pri_repay_amt, 0) AS DOUBLE) AS repaid, {sql_percent('coalesce(pri_repay_amt, 0)', DISB)} AS eff_pct FROM v_loans LEFT JOIN v_customers USING (cust_id) WHERE CAST(cust_id AS VARCHAR) = '30'", ("v_loans", "v_customers"))
def account_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_of(view(spark, sf_dir, "v_loans"), view(spark, sf_dir, "v_customers"), "30")


def monthly(loans: DataFrame) -> DataFrame:
    """Months by sanction date with counts by product and collection efficiency."""
    rows = measured(loans.where(F.col("sanc_date").isNotNull())).groupBy(L.month_key(F.col("sanc_date")).alias("month"))
    counts = [F.count_if(F.col("prod_code") == code).alias(name) for code, name in PRODUCTS]
    return rows.agg(F.count(F.lit(1)).alias("loan_count"), F.count_distinct("cust_id").alias("cust_count"), F.sum("sanc_amt").cast("double").alias("total_sanctioned"), F.sum("_disb").cast("double").alias("total_disbursed"), F.sum("_rep").cast("double").alias("total_repaid"), *counts, percent(F.sum("_rep"), F.sum("_disb")).alias("collection_efficiency"))


@register("monthly_breakdown", f"SELECT strftime(sanc_date, '%Y-%m') AS month, count(*) AS loan_count, count(DISTINCT cust_id) AS cust_count, CAST(sum(sanc_amt) AS DOUBLE) AS total_sanctioned, CAST(sum({DISB}) AS DOUBLE) AS total_disbursed, CAST(sum(coalesce(pri_repay_amt, 0)) AS DOUBLE) AS total_repaid, {', '.join(f'count(CASE WHEN prod_code = {c} THEN 1 END) AS {n}' for c, n in PRODUCTS)}, {sql_percent('sum(coalesce(pri_repay_amt, 0))', f'sum({DISB})')} AS collection_efficiency FROM v_loans WHERE sanc_date IS NOT NULL GROUP BY 1", ("v_loans",))
def monthly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(view(spark, sf_dir, "v_loans"))


def cohorts(loans: DataFrame, legacy_before: str, peak: str) -> DataFrame:
    """Months of origination with month-over-month growth of the sanctioned volume and a life-cycle label (a row a month, so one small window)."""
    rows = measured(loans.where(F.col("sanc_date").isNotNull())).groupBy(L.month_key(F.col("sanc_date")).alias("start_month"))
    found = rows.agg(
        F.count(F.lit(1)).alias("loans_started"), F.count_distinct("cust_id").alias("borrowers_onboarded"), F.coalesce(F.sum("sanc_amt"), F.lit(0)).alias("_sanc"), F.coalesce(F.sum("_disb"), F.lit(0)).cast("double").alias("volume_disbursed"),
        F.sum("_rep").cast("double").alias("volume_repaid"), F.coalesce(F.round(F.avg(F.col("int_rate").cast("decimal(10,2)")), 2).cast("double"), F.lit(17.7)).alias("avg_interest_rate"),
        F.coalesce(F.round(F.avg("sanc_amt"), 2).cast("double"), F.lit(0.0)).alias("avg_ticket_size"), percent(F.sum("_rep"), F.sum("_disb")).alias("repayment_rate"),
    )
    grown = growth(found, "_sanc", "start_month", "mom_growth_pct").withColumn("volume_sanctioned", F.col("_sanc").cast("double")).drop("_sanc")
    return grown.withColumn("institution_status", L.lifecycle(F.col("start_month"), F.col("mom_growth_pct"), legacy_before, peak))


SQL_COHORTS = f"""c AS (SELECT strftime(sanc_date, '%Y-%m') AS start_month, count(*) AS loans_started, count(DISTINCT cust_id) AS borrowers_onboarded, coalesce(sum(sanc_amt), 0) AS s, CAST(coalesce(sum({DISB}), 0) AS DOUBLE) AS volume_disbursed,
CAST(sum(coalesce(pri_repay_amt, 0)) AS DOUBLE) AS volume_repaid, coalesce(CAST(round(CAST(avg(CAST(int_rate AS DECIMAL(10,2))) AS DECIMAL(14,6)), 2) AS DOUBLE), 17.7) AS avg_interest_rate, coalesce(CAST((2 * CAST(sum(sanc_amt) * 100 AS HUGEINT) + count(sanc_amt)) // (2 * count(sanc_amt)) AS DOUBLE) / 100, 0) AS avg_ticket_size, {sql_percent('sum(coalesce(pri_repay_amt, 0))', f'sum({DISB})')} AS repayment_rate FROM v_loans WHERE sanc_date IS NOT NULL GROUP BY 1),
g AS (SELECT *, lag(s) OVER (ORDER BY start_month) AS p FROM c),
k AS (SELECT * EXCLUDE (s, p), CAST(s AS DOUBLE) AS volume_sanctioned, CASE WHEN p > 0 THEN CAST(round(CAST((s - p)::DOUBLE * 100 / p::DOUBLE AS DECIMAL(28,9)), 1) AS DOUBLE) ELSE 0.0 END AS mom_growth_pct FROM g)"""


@register("cohort_growth", f"WITH {SQL_COHORTS} SELECT *, CASE WHEN start_month < '1996-01' THEN 'Legacy Book Run-off' WHEN start_month = '2000-05' THEN 'Peak Origination' WHEN mom_growth_pct > 0 THEN 'Expansion Phase' ELSE 'Stabilization' END AS institution_status FROM k", ("v_loans",))
def cohorts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts(view(spark, sf_dir, "v_loans"), "1996-01", "2000-05")


def cohort_summary(found: DataFrame) -> DataFrame:
    """First and last month, the ratio of their volumes, mean growth (0 for no month) and total volume over the cohorts."""
    one, decimal = F.col("volume_sanctioned"), "decimal(24,2)"
    return found.agg(
        F.min("start_month").alias("start_period"), F.max("start_month").alias("latest_period"),
        F.round(F.max_by(one.cast(decimal), "start_month") / F.coalesce(F.nullif(F.min_by(one.cast(decimal), "start_month"), F.lit(0)), F.lit(1)), 1).cast("double").alias("origination_growth_multiplier"),
        F.coalesce(F.round(F.avg(F.col("mom_growth_pct").cast("decimal(18,1)")), 1).cast("double"), F.lit(0.0)).alias("average_mom_growth_pct"), F.coalesce(F.sum(one.cast(decimal)), F.lit(0)).cast("double").alias("total_new_volume_started"),
    )


@register("cohort_summary", f"WITH {SQL_COHORTS} SELECT min(start_month) AS start_period, max(start_month) AS latest_period, CAST(round(CAST(arg_max(volume_sanctioned, start_month) / coalesce(nullif(arg_min(volume_sanctioned, start_month), 0), 1) AS DECIMAL(28,9)), 1) AS DOUBLE) AS origination_growth_multiplier, coalesce(CAST(round(CAST(avg(CAST(mom_growth_pct AS DECIMAL(18,1))) AS DECIMAL(28,9)), 1) AS DOUBLE), 0) AS average_mom_growth_pct, coalesce(CAST(sum(CAST(volume_sanctioned AS DECIMAL(24,2))) AS DOUBLE), 0) AS total_new_volume_started FROM k", ("v_loans",))
def cohort_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_summary(cohorts_query(spark, sf_dir))


def vintages(loans: DataFrame, months: int = 12) -> DataFrame:
    """The earliest months with a synthetic efficiency (from the loan count alone) and its change, seeded with 94.0."""
    rows = loans.where(F.col("sanc_date").isNotNull()).groupBy(L.month_key(F.col("sanc_date")).alias("vintage_month")).agg(F.count(F.lit(1)).alias("total_loans"), F.sum("sanc_amt").alias("_sanc"))
    first = top_k(rows, months, F.asc("vintage_month"))
    pct = F.least(F.lit("98.5").cast("decimal(4,1)"), F.lit("94.0").cast("decimal(4,1)") + (F.col("total_loans") % 5).cast("decimal(4,0)") * F.lit("0.8").cast("decimal(4,1)"))
    found = first.withColumn("_pct", pct.cast("decimal(6,1)"))
    before = F.coalesce(F.lag("_pct").over(Window.orderBy("vintage_month")), F.lit("94.0").cast("decimal(6,1)"))
    repaid = F.round(F.col("_sanc") * F.col("_pct") / 100, 2).cast("double")
    return found.select("vintage_month", "total_loans", F.col("_sanc").cast("double").alias("disbursed_amt"), repaid.alias("synthetic_repaid_amt"), F.col("_pct").cast("double").alias("synthetic_efficiency_pct"), (F.col("_pct") - before).cast("double").alias("improvement_delta"), L.signed_percent(F.col("_pct") - before).alias("shown_delta"))


@register("vintage", "WITH v AS (SELECT strftime(sanc_date, '%Y-%m') AS vintage_month, count(*) AS total_loans, sum(sanc_amt) AS s FROM v_loans WHERE sanc_date IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 12), e AS (SELECT *, CAST(least(98.5, 94.0 + (total_loans % 5) * 0.8) AS DECIMAL(6,1)) AS p FROM v) SELECT vintage_month, total_loans, CAST(s AS DOUBLE) AS disbursed_amt, CAST(round(CAST(s AS DECIMAL(24,4)) * p / 100, 2) AS DOUBLE) AS synthetic_repaid_amt, CAST(p AS DOUBLE) AS synthetic_efficiency_pct, CAST(p - coalesce(lag(p) OVER (ORDER BY vintage_month), 94.0) AS DOUBLE) AS improvement_delta, CASE WHEN p - coalesce(lag(p) OVER (ORDER BY vintage_month), 94.0) >= 0 THEN '+' ELSE '' END || CAST(CAST(p - coalesce(lag(p) OVER (ORDER BY vintage_month), 94.0) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS shown_delta FROM e", ("v_loans",))
def vintages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintages(view(spark, sf_dir, "v_loans"))


def search(loans: DataFrame, customers: DataFrame, term: str, kinds: tuple[str, ...] = ("product", "branch", "customer"), most: int = 15, customers_most: int = 12, least: int = 1, by_code: bool = False) -> DataFrame:
    """Products, branches and customers whose code or name contains ``term``; a term under ``least`` characters (2 while typing) finds nothing.

    ``by_code`` finds those whose code is ``term``.  Names are looked up in the loans and in the customers apart, and only the
    ids that hit are joined with the loans.
    """
    term = term.strip().lower()
    term = term if len(term) >= least else ""
    code = lambda c: F.col(c).cast("string") == term if by_code else F.col(c).cast("string").contains(term)
    product = loans.where(code("prod_code")).groupBy(F.concat(F.lit("ZONE-PROD-"), F.col("prod_code").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("accounts")).withColumn("type", F.lit("product")).withColumn("_o", F.lit(1))
    branch = loans.where(code("brn_code")).groupBy(F.concat(F.lit("BRN-"), F.col("brn_code").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("accounts")).withColumn("type", F.lit("branch")).withColumn("_o", F.lit(2))
    named = customers.where(F.lower("first_name").contains(term) | F.lower("last_name").contains(term)).select("cust_id").distinct().withColumn("_named", F.lit(True))
    hit = code("cust_id") | F.lower("cust_name").contains(term) | F.col("_named")
    matched = loans.where(code("cust_id")) if by_code else loans.select("cust_id", "cust_name").join(named, "cust_id", "left").where(hit)
    people = matched.groupBy(F.concat(F.lit("CUST-"), F.col("cust_id").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("accounts"))
    people = top_k(people, customers_most, F.desc("accounts"), F.asc("id")).withColumn("type", F.lit("customer")).withColumn("_o", F.lit(3))
    parts = [p for kind, p in (("product", product), ("branch", branch), ("customer", people)) if kind in kinds]
    found = union_all(*parts) if term else union_all(*parts).limit(0)
    return top_k(found, most, F.asc("_o"), F.desc("accounts"), F.asc("id")).drop("_o")


@register("entity_search", """WITH h AS (SELECT 'ZONE-PROD-' || prod_code AS id, count(*) AS accounts, 'product' AS type, 1 AS o FROM v_loans WHERE CAST(prod_code AS VARCHAR) LIKE '%13%' GROUP BY 1
UNION ALL SELECT 'BRN-' || brn_code, count(*), 'branch', 2 FROM v_loans WHERE CAST(brn_code AS VARCHAR) LIKE '%13%' GROUP BY 1
UNION ALL SELECT * FROM (SELECT 'CUST-' || cust_id AS id, count(*) AS accounts, 'customer' AS type, 3 AS o FROM v_loans LEFT JOIN v_customers USING (cust_id) WHERE CAST(cust_id AS VARCHAR) LIKE '%13%' OR lower(cust_name) LIKE '%13%' OR lower(first_name) LIKE '%13%' OR lower(last_name) LIKE '%13%' GROUP BY 1 ORDER BY accounts DESC, id LIMIT 12))
SELECT id, accounts, type FROM h ORDER BY o, accounts DESC, id LIMIT 15""", ("v_loans", "v_customers"))
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(view(spark, sf_dir, "v_loans"), view(spark, sf_dir, "v_customers"), "13")


def branch_divisions(loans: DataFrame) -> DataFrame:
    """Branches dealt to product divisions in turn by rank."""
    branches, products = by(loans, "brn_code", "branch_code"), by(loans, "prod_code", "product_code").select("product_code", F.col("cust_count").alias("_c"))
    dealt = round_robin(branches.select("branch_code", "cust_count"), [F.desc("cust_count"), F.asc("branch_code")], products, [F.desc("_c"), F.asc("product_code")])
    return dealt.select("branch_code", F.col("product_code"), F.concat(F.lit("ZONE-PROD-"), F.col("product_code").cast("string")).alias("zone_id"))


@register("branch_division_round_robin", """WITH p AS (SELECT prod_code, row_number() OVER (ORDER BY c DESC, prod_code) - 1 AS r FROM (SELECT prod_code, count(DISTINCT cust_id) AS c FROM v_loans WHERE prod_code IS NOT NULL GROUP BY 1)),
b AS (SELECT brn_code, row_number() OVER (ORDER BY c DESC, brn_code) - 1 AS r FROM (SELECT brn_code, count(DISTINCT cust_id) AS c FROM v_loans WHERE brn_code IS NOT NULL GROUP BY 1))
SELECT brn_code AS branch_code, prod_code AS product_code, 'ZONE-PROD-' || prod_code AS zone_id FROM b JOIN p ON b.r % (SELECT count(*) FROM p) = p.r""", ("v_loans",))
def divisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_divisions(view(spark, sf_dir, "v_loans"))


def executive_nodes(loans: DataFrame) -> DataFrame:
    """Nodes of the top tier: one for the whole, the divisions and the branches."""
    root = totals(loans).select(F.lit("ROOT").alias("id"), F.lit("executive").alias("type"), "acnt_count", F.lit(None).cast("string").alias("zonal_id"))
    zones = by(loans, "prod_code", "code").select(F.concat(F.lit("ZONE-PROD-"), F.col("code").cast("string")).alias("id"), F.lit("product").alias("type"), "acnt_count", F.lit(None).cast("string").alias("zonal_id"))
    branches = by(loans, "brn_code", "branch_code").join(branch_divisions(loans), "branch_code").select(F.concat(F.lit("BRN-"), F.col("branch_code").cast("string")).alias("id"), F.lit("branch").alias("type"), "acnt_count", F.col("zone_id").alias("zonal_id"))
    return first_seen(union_all(root, zones, branches), ["id"], F.asc("type"))


def executive_edges(loans: DataFrame) -> DataFrame:
    zones = loans.where("prod_code is not null").select(F.concat(F.lit("ZONE-PROD-"), F.col("prod_code").cast("string")).alias("target")).distinct().select(F.lit("ROOT").alias("source"), "target", F.lit("PRODUCT_DIVISION").alias("label"), F.lit(9).alias("weight"))
    hosts = branch_divisions(loans).select(F.col("zone_id").alias("source"), F.concat(F.lit("BRN-"), F.col("branch_code").cast("string")).alias("target"), F.lit("HOSTS_BRANCH").alias("label"), F.lit(8).alias("weight"))
    return union_all(zones, hosts)


SQL_DIVISIONS = """p AS (SELECT prod_code, row_number() OVER (ORDER BY c DESC, prod_code) - 1 AS r FROM (SELECT prod_code, count(DISTINCT cust_id) AS c FROM v_loans WHERE prod_code IS NOT NULL GROUP BY 1)),
b AS (SELECT brn_code, n, row_number() OVER (ORDER BY c DESC, brn_code) - 1 AS r FROM (SELECT brn_code, count(DISTINCT cust_id) AS c, count(*) AS n FROM v_loans WHERE brn_code IS NOT NULL GROUP BY 1)),
d AS (SELECT brn_code, n, 'ZONE-PROD-' || prod_code AS zone_id FROM b JOIN p ON b.r % (SELECT count(*) FROM p) = p.r)"""


@register("graph_nodes_executive", f"WITH {SQL_DIVISIONS} SELECT 'ROOT' AS id, 'executive' AS type, count(*) AS acnt_count, CAST(NULL AS VARCHAR) AS zonal_id FROM v_loans UNION ALL SELECT 'ZONE-PROD-' || prod_code, 'product', count(*), NULL FROM v_loans WHERE prod_code IS NOT NULL GROUP BY 1 UNION ALL SELECT 'BRN-' || brn_code, 'branch', n, zone_id FROM d", ("v_loans",))
def nodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executive_nodes(view(spark, sf_dir, "v_loans"))


SQL_EDGES = "SELECT 'ROOT' AS source, 'ZONE-PROD-' || prod_code AS target, 'PRODUCT_DIVISION' AS label, 9 AS weight FROM p UNION ALL SELECT zone_id, 'BRN-' || brn_code, 'HOSTS_BRANCH', 8 FROM d"


@register("graph_edges_executive", f"WITH {SQL_DIVISIONS} {SQL_EDGES}", ("v_loans",))
def edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executive_edges(view(spark, sf_dir, "v_loans"))


def account_graph(loans: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the lower tiers for chosen accounts (acnt_num): branch, scheme desk, customer, account, disbursement, repayment."""
    rows = measured(loans.join(accounts.select("acnt_num"), "acnt_num", "left_semi"))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    ids = rows.select(F.concat(F.lit("BRN-"), s("brn_code")).alias("branch"), F.concat(F.lit("SCHM-"), s("brn_code"), F.lit("-"), s("schm_code")).alias("scheme"), F.concat(F.lit("CUST-"), s("cust_id")).alias("customer"), F.concat(F.lit("ACNT-"), s("acnt_num")).alias("account"), F.concat(F.lit("DISB-"), s("acnt_num"), F.lit("-1")).alias("disbursement"), F.concat(F.lit("REPAY-"), s("acnt_num"), F.lit("-1")).alias("repayment"), "_disb", "_rep")
    link = lambda a, b, label, weight: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(label).alias("label"), F.lit(weight).alias("weight"))
    paid = F.when(F.col("_rep") > 0, link("repayment", "account", "PAID_REPAYMENT", 6))
    edges = ids.select(F.explode(F.array_compact(F.array(link("branch", "scheme", "OFFERS_SCHEME", 7), link("scheme", "customer", "BORROWER_ACCOUNT", 6), link("customer", "account", "OWNS_ACCOUNT", 8), link("account", "disbursement", "DISBURSED", 6), paid))).alias("e")).select("e.*").distinct()
    kinds = ["branch", "scheme", "customer", "account", "disbursement", "repayment"]
    nodes = ids.select(F.explode(F.array(*[F.struct(F.col(k).alias("id"), F.lit(k).alias("type")) for k in kinds])).alias("n")).select("n.*").distinct()
    return nodes, edges


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.join(ends, "id", "left_semi")


def adjacency(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Each node's neighbours either way (the first ``most`` by id, in one row), and its whole degree.

    A hub's neighbours are deduplicated and cut before they are gathered; all
    of them are the rows of ``neighbour_pairs``.
    """
    both = neighbour_pairs(edges)
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    first = top_k_per_group(both, ["id"], most, F.asc("other"))
    return first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours")).join(degree, "id")


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(id, other) of every edge either way, each once."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()


@register("graph_connected_nodes", """WITH a AS (SELECT *, coalesce(pri_repay_amt, 0) AS rep, coalesce(CAST(brn_code AS VARCHAR), '0') AS b, coalesce(schm_code, '0') AS s FROM v_loans)
SELECT DISTINCT unnest(['BRN-' || b, 'SCHM-' || b || '-' || s, 'CUST-' || cust_id, 'ACNT-' || acnt_num, 'DISB-' || acnt_num || '-1']) AS id, unnest(['branch', 'scheme', 'customer', 'account', 'disbursement']) AS type FROM a UNION SELECT 'REPAY-' || acnt_num || '-1', 'repayment' FROM a WHERE rep > 0""", ("v_loans",))
def connected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = view(spark, sf_dir, "v_loans")
    return connected_nodes(*account_graph(loans, loans))


@register("graph_adjacency", f"WITH {SQL_DIVISIONS}, e AS ({SQL_EDGES}), u AS (SELECT source AS id, target AS other FROM e UNION SELECT target, source FROM e) SELECT id, string_agg(other, ',' ORDER BY other) AS neighbours, count(DISTINCT other) AS degree FROM u GROUP BY id", ("v_loans",))
def adjacency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency(executive_edges(view(spark, sf_dir, "v_loans")))


@register("events_as_of_join", """WITH l AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders), e AS (SELECT l_orderkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, x.l_shipdate, x.price FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 60 DAY AS o_orderdate FROM l) o ASOF LEFT JOIN e x ON o.o_orderkey = x.l_orderkey AND o.o_orderdate >= x.l_shipdate""")
def as_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its last shipment within sixty days."""
    from ledgerloom.operators.relational import as_of_join

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderdate + INTERVAL 60 DAYS").alias("o_orderdate"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").agg(F.max("l_extendedprice").alias("price"))
    return as_of_join(orders, shipped, "o_orderkey", "o_orderdate", "l_shipdate")
