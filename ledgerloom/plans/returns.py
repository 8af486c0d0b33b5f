"""Sections of the regulatory return: point-in-time extractions, derived lines, and report cells.

Only the end date reaches the extractions.  Amounts are in lakhs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import lending as L
from ledgerloom.functions import periods
from ledgerloom.operators.relational import latest_as_of, percent, share_of_total, top_k
from ledgerloom.plans.domain import view
from ledgerloom.plans.registry import register, sql_lakhs, sql_percent

AS_OF = "2000-06-30"
SQL_LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_num ORDER BY effective_date DESC, tiebreak_1 DESC, tiebreak_2 DESC, tiebreak_3 DESC, princ_os DESC, charg_due DESC NULLS LAST) AS rn
  FROM v_asset_history WHERE effective_date <= DATE '{AS_OF}') WHERE rn = 1)"""
IN_BOOK = f"(sanc_date IS NULL OR sanc_date <= DATE '{AS_OF}')"
OUTSTANDING = "coalesce(lndisb_amt, sanc_amt) - coalesce(pri_repay_amt, 0)"


def in_book(as_of: str) -> Column:
    """Sanctioned by then; an unknown date counts as in."""
    return F.col("sanc_date").isNull() | (F.col("sanc_date") <= F.to_date(F.lit(as_of)))


def latest_assets(history: DataFrame, as_of: str) -> DataFrame:
    ties = [F.desc("tiebreak_1"), F.desc("tiebreak_2"), F.desc("tiebreak_3"), F.desc("princ_os"), F.desc_nulls_last("charg_due")]
    return latest_as_of(history, "account_num", "effective_date", as_of, ties)


def book_outstanding() -> Column:
    return L.outstanding(F.col("lndisb_amt"), F.col("sanc_amt"), F.col("pri_repay_amt"))


def annex9(loans: DataFrame, customers: DataFrame, history: DataFrame, as_of: str, k: int = 25) -> DataFrame:
    """The largest borrowers: classified balances where all parts are known, else the ledger's."""
    latest = latest_assets(history, as_of).select(F.col("account_num").alias("acnt_num"), "asset_code", "princ_os", "int_due", "charg_due")
    rows = loans.where(in_book(as_of)).join(customers, "cust_id", "left").join(latest, "acnt_num", "left")
    ledger = F.col("lndisb_amt") - F.col("pri_repay_amt")
    total = F.coalesce(F.col("princ_os") + F.col("int_due") + F.col("charg_due"), ledger, F.lit(0))
    rows = rows.select(
        "acnt_num",
        L.annex_name(F.col("cust_name"), [F.col("first_name"), F.col("middle_name"), F.col("last_name")], F.col("acnt_num")).alias("borrower_name"),
        F.lit("NA").alias("pan"),
        F.when(F.col("prod_code") == 16, "CORPORATE").otherwise("INDIVIDUAL").alias("borrower_type"),
        L.lakhs(F.col("sanc_amt")).alias("sanctioned_amt"),
        L.lakhs(F.coalesce("lndisb_amt", "sanc_amt")).alias("disbursed_amt"),
        L.lakhs(F.coalesce(F.col("princ_os"), ledger, F.lit(0))).alias("principal_outstanding"),
        L.lakhs(F.coalesce("int_due", F.lit(0))).alias("accrued_interest"),
        L.account_status(F.col("asset_code")).alias("account_status"),
        L.lakhs(total).alias("total_outstanding"),
        total.alias("_total"),
    )
    return top_k(rows, k, F.desc("_total"), F.asc("acnt_num")).drop("_total")


@register("annex9_top_borrowers", f"""
WITH {SQL_LATEST}
SELECT acnt_num, coalesce(nullif(cust_name, ''), trim(concat_ws(' ', first_name, middle_name, last_name)), 'Account #' || CAST(acnt_num AS VARCHAR)) AS borrower_name, 'NA' AS pan,
  CASE WHEN prod_code = 16 THEN 'CORPORATE' ELSE 'INDIVIDUAL' END AS borrower_type, {sql_lakhs('sanc_amt')} AS sanctioned_amt, {sql_lakhs('coalesce(lndisb_amt, sanc_amt)')} AS disbursed_amt,
  {sql_lakhs('coalesce(princ_os, lndisb_amt - pri_repay_amt, 0)')} AS principal_outstanding, {sql_lakhs('coalesce(int_due, 0)')} AS accrued_interest,
  CASE WHEN asset_code IN ('STD', 'SMA0') THEN 'Standard' ELSE coalesce(asset_code, 'Standard') END AS account_status,
  {sql_lakhs('coalesce(princ_os + int_due + charg_due, lndisb_amt - pri_repay_amt, 0)')} AS total_outstanding
FROM v_loans LEFT JOIN v_customers USING (cust_id) LEFT JOIN latest ON account_num = acnt_num WHERE {IN_BOOK}
ORDER BY coalesce(princ_os + int_due + charg_due, lndisb_amt - pri_repay_amt, 0) DESC, acnt_num LIMIT 25""", ("v_loans", "v_customers", "v_asset_history"))
def annex9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex9(view(spark, sf_dir, "v_loans"), view(spark, sf_dir, "v_customers"), view(spark, sf_dir, "v_asset_history"), AS_OF)


def annex13(loans: DataFrame, as_of: str) -> DataFrame:
    """Branches by outstanding; loans without a branch are left out."""
    return loans.where(F.col("brn_code").isNotNull() & in_book(as_of)).groupBy(F.col("brn_code").cast("long").alias("branch_code")).agg(F.count_distinct("cust_id").alias("customer_count"), F.count(F.lit(1)).alias("account_count"), L.lakhs(F.sum(book_outstanding())).alias("total_outstanding"))


@register("annex13_branches", f"SELECT CAST(brn_code AS BIGINT) AS branch_code, count(DISTINCT cust_id) AS customer_count, count(*) AS account_count, {sql_lakhs(f'sum({OUTSTANDING})')} AS total_outstanding FROM v_loans WHERE brn_code IS NOT NULL AND {IN_BOOK} GROUP BY brn_code", ("v_loans",))
def annex13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex13(view(spark, sf_dir, "v_loans"), AS_OF)


def portfolio_totals(loans: DataFrame, as_of: str) -> DataFrame:
    return loans.where(in_book(as_of)).agg(L.lakhs(F.coalesce(F.sum(book_outstanding()), F.lit(0))).alias("total_loan_book"), L.lakhs(F.coalesce(F.sum("pri_repay_amt"), F.lit(0))).alias("total_repaid"))


@register("portfolio_totals_as_of", f"SELECT {sql_lakhs(f'coalesce(sum({OUTSTANDING}), 0)')} AS total_loan_book, {sql_lakhs('coalesce(sum(pri_repay_amt), 0)')} AS total_repaid FROM v_loans WHERE {IN_BOOK}", ("v_loans",))
def portfolio_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio_totals(view(spark, sf_dir, "v_loans"), AS_OF)


def annex10(investments: DataFrame, k: int = 25) -> DataFrame:
    """The largest investments; amounts over 10,000 are taken for rupees."""
    rows = investments.select(
        "inv_id", "entity_name", F.coalesce("investment_nature", F.lit("Long Term")).alias("nature"), F.coalesce("investment_type", F.lit("Equity")).alias("investment_type"), F.coalesce("pan", F.lit("NA")).alias("pan"),
        L.mixed_lakhs(F.col("book_value")).alias("book_value"), F.when(F.col("is_group_company"), "true").otherwise("false").alias("is_group_company"), L.mixed_lakhs(F.coalesce("amount_outstanding", "book_value")).alias("amt_outstanding"),
    )
    return top_k(rows, k, F.desc("amt_outstanding"), F.asc("inv_id"))


def _sql_mixed(x: str) -> str:
    return f"CASE WHEN {x} > 10000 THEN {sql_lakhs(x)} ELSE CAST({x} AS DOUBLE) END"


@register("annex10_investments", f"""SELECT inv_id, entity_name, coalesce(investment_nature, 'Long Term') AS nature, coalesce(investment_type, 'Equity') AS investment_type, coalesce(pan, 'NA') AS pan,
{_sql_mixed('book_value')} AS book_value, CASE WHEN is_group_company THEN 'true' ELSE 'false' END AS is_group_company, {_sql_mixed('coalesce(amount_outstanding, book_value)')} AS amt_outstanding
FROM v_investments ORDER BY amt_outstanding DESC, inv_id LIMIT 25""", ("v_investments",))
def annex10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex10(view(spark, sf_dir, "v_investments"))


def annex10_from_ledger(balances: DataFrame, heads: DataFrame, k: int = 25) -> DataFrame:
    """Investments read from general-ledger heads by name, where no register is kept."""
    head = F.col("head_descn")
    rows = balances.join(heads, F.col("glacc_code") == F.col("access_code")).where(head.ilike("%INVEST%") | head.ilike("%MUTUAL%") | head.ilike("%SHARE%"))
    rows = rows.select("glacc_code", head.alias("entity_name"), L.head_nature(head).alias("nature"), L.head_type(head).alias("investment_type"), L.lakhs(F.abs(F.coalesce("bc_bal", F.lit(0)))).alias("book_value"), F.lit("false").alias("is_group_company"))
    return top_k(rows, k, F.desc("book_value"), F.asc("glacc_code"))


@register("annex10_gl_fallback", f"""SELECT glacc_code, head_descn AS entity_name, CASE WHEN head_descn ILIKE '%MUTUAL%' THEN 'Mutual Fund' WHEN head_descn ILIKE '%CURRENT%' THEN 'Current' ELSE 'Long Term' END AS nature,
CASE WHEN head_descn ILIKE '%DEBENTURE%' THEN 'Debentures' WHEN head_descn ILIKE '%DEPOSIT%' THEN 'Deposits' ELSE 'Equity' END AS investment_type, {sql_lakhs('abs(coalesce(bc_bal, 0))')} AS book_value, 'false' AS is_group_company
FROM v_gl_balances JOIN v_gl_heads ON glacc_code = access_code WHERE head_descn ILIKE '%INVEST%' OR head_descn ILIKE '%MUTUAL%' OR head_descn ILIKE '%SHARE%' ORDER BY book_value DESC, glacc_code LIMIT 25""", ("v_gl_balances", "v_gl_heads"))
def annex10_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex10_from_ledger(view(spark, sf_dir, "v_gl_balances"), view(spark, sf_dir, "v_gl_heads"))


def asset_quality(history: DataFrame, as_of: str) -> DataFrame:
    """Accounts, amount and provision by bucket of the latest classification."""
    latest = latest_assets(history, as_of).withColumn("status", L.asset_bucket(F.col("asset_code")))
    found = latest.groupBy("status").agg(F.count(F.lit(1)).alias("account_count"), F.coalesce(F.sum("princ_os"), F.lit(0)).alias("amount"))
    return found.select("status", "account_count", L.lakhs(F.col("amount")).alias("amount_lakhs"), L.lakhs(F.col("amount") * L.provision_rate(F.col("status"))).alias("provision_lakhs"))


SQL_BUCKET = "CASE WHEN asset_code IN ('STD', 'SMA0') THEN 'Standard' WHEN asset_code = 'SMA1' THEN 'SMA-1' WHEN asset_code IN ('SUB', 'NPA') THEN 'Sub-Standard' ELSE 'Doubtful / Loss' END"


@register("part8_asset_quality", f"""WITH {SQL_LATEST}, b AS (SELECT {SQL_BUCKET} AS status, count(*) AS account_count, coalesce(sum(princ_os), 0) AS amount FROM latest GROUP BY 1)
SELECT status, account_count, {sql_lakhs('amount')} AS amount_lakhs, {sql_lakhs("CAST(amount * CASE WHEN status LIKE '%Sub-Standard%' THEN 0.150 WHEN status LIKE '%Doubtful%' THEN 1.000 ELSE 0.004 END AS DECIMAL(24,2))")} AS provision_lakhs FROM b""", ("v_asset_history",))
def asset_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asset_quality(view(spark, sf_dir, "v_asset_history"), AS_OF)


def npa_ratio(quality: DataFrame, totals: DataFrame) -> DataFrame:
    """Non-performing amount over the loan book; null for an empty book (two one-row relations joined)."""
    bad = F.col("status").contains("NPA") | F.col("status").contains("Sub-Standard") | F.col("status").contains("Doubtful")
    npa = quality.agg(F.coalesce(F.sum(F.when(bad, F.col("amount_lakhs").cast("decimal(24,2)"))), F.lit(0)).alias("npa"))
    one = F.lit(1)
    both = npa.withColumn("_k", one).join(totals.withColumn("_k", one), "_k")
    book = F.col("total_loan_book").cast("decimal(24,2)")
    return both.select(F.col("npa").cast("double").alias("npa_lakhs"), "total_loan_book", F.when(book > 0, percent(F.col("npa"), book, 2)).alias("npa_ratio_pct"))


@register("npa_ratio", f"""WITH {SQL_LATEST}, b AS (SELECT {SQL_BUCKET} AS status, {sql_lakhs('coalesce(sum(princ_os), 0)')} AS amount_lakhs FROM latest GROUP BY 1),
n AS (SELECT coalesce(sum(CAST(amount_lakhs AS DECIMAL(24,2))), 0) AS npa FROM b WHERE status LIKE '%NPA%' OR status LIKE '%Sub-Standard%' OR status LIKE '%Doubtful%'),
t AS (SELECT {sql_lakhs(f'coalesce(sum({OUTSTANDING}), 0)')} AS total_loan_book FROM v_loans WHERE {IN_BOOK})
SELECT CAST(npa AS DOUBLE) AS npa_lakhs, total_loan_book, CASE WHEN total_loan_book > 0 THEN {sql_percent('npa', 'total_loan_book', 2)} END AS npa_ratio_pct FROM n, t""", ("v_asset_history", "v_loans"))
def npa_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return npa_ratio(asset_quality(view(spark, sf_dir, "v_asset_history"), AS_OF), portfolio_totals(view(spark, sf_dir, "v_loans"), AS_OF))


def msme_bands(loans: DataFrame, as_of: str) -> DataFrame:
    """MSME loans by size of the sanctioned amount, smallest band first."""
    band = L.size_band(F.col("sanc_amt"))
    found = loans.where((F.col("prod_code") == 16) & in_book(as_of)).groupBy(band.alias("category")).agg(F.count(F.lit(1)).alias("account_count"), L.lakhs(F.sum(book_outstanding())).alias("amount_lakhs"), F.coalesce(F.round(F.avg(F.col("int_rate").cast("decimal(10,2)")), 1).cast("double"), F.lit(17.5)).alias("avg_interest_rate"))
    return found.withColumn("band_no", F.when(F.col("category") == "Micro", 1).when(F.col("category") == "Small", 2).otherwise(3)).orderBy("band_no")


@register("part8a_msme_bands", f"""WITH b AS (SELECT CASE WHEN coalesce(sanc_amt, 0) <= 2500000 THEN 'Micro' WHEN coalesce(sanc_amt, 0) <= 10000000 THEN 'Small' ELSE 'Medium' END AS category, count(*) AS account_count,
{sql_lakhs(f'sum({OUTSTANDING})')} AS amount_lakhs, coalesce(CAST(round(CAST(avg(CAST(int_rate AS DECIMAL(10,2))) AS DECIMAL(14,6)), 1) AS DOUBLE), 17.5) AS avg_interest_rate FROM v_loans WHERE prod_code = 16 AND {IN_BOOK} GROUP BY 1)
SELECT *, CASE category WHEN 'Micro' THEN 1 WHEN 'Small' THEN 2 ELSE 3 END AS band_no FROM b""", ("v_loans",))
def msme_bands_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msme_bands(view(spark, sf_dir, "v_loans"), AS_OF)


def shareholders(shares: DataFrame, k: int = 10) -> DataFrame:
    """The largest holders; the share is of the rows shown."""
    units, face = F.coalesce("no_of_units", F.lit(1)), F.coalesce("face_value", F.lit(10).cast("decimal(18,2)"))
    held = shares.groupBy(F.coalesce("share_customer_name", F.lit("Member Shareholder")).alias("name")).agg(F.sum(units).cast("long").alias("num_shares"), F.coalesce(F.avg("face_value").cast("double"), F.lit(10.0)).alias("face_value"), F.sum(units * face).alias("_value"))
    found = top_k(held, k, F.desc("_value"), F.asc("name"))
    return share_of_total(found, "_value", "shareholding_pct").select("name", F.lit("Equity Shares").alias("type_of_capital"), "num_shares", "face_value", "shareholding_pct")


@register("annex2_shareholders", f"""WITH h AS (SELECT coalesce(share_customer_name, 'Member Shareholder') AS name, CAST(sum(coalesce(no_of_units, 1)) AS BIGINT) AS num_shares, coalesce(CAST(avg(face_value) AS DOUBLE), 10.0) AS face_value, sum(coalesce(no_of_units, 1) * coalesce(face_value, 10)) AS v FROM v_shares GROUP BY 1 ORDER BY v DESC, name LIMIT 10)
SELECT name, 'Equity Shares' AS type_of_capital, num_shares, face_value, {sql_percent('v', '(SELECT sum(v) FROM h)')} AS shareholding_pct FROM h""", ("v_shares",))
def shareholders_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shareholders(view(spark, sf_dir, "v_shares"))


def product_mix(loans: DataFrame, as_of: str) -> DataFrame:
    found = loans.where(in_book(as_of)).groupBy(L.product_label(F.col("prod_code")).alias("category")).agg(F.sum(book_outstanding()).alias("_amount"))
    return share_of_total(found, "_amount", "share_pct").select("category", L.lakhs(F.col("_amount")).alias("amount_lakhs"), "share_pct")


@register("part2_product_mix", f"""WITH p AS (SELECT CASE prod_code WHEN 16 THEN 'MSME Loans' WHEN 13 THEN 'Microfinance Loans' WHEN 1 THEN 'Gold Loans' ELSE 'Other Loans (Product ' || coalesce(CAST(prod_code AS VARCHAR), '0') || ')' END AS category, sum({OUTSTANDING}) AS a FROM v_loans WHERE {IN_BOOK} GROUP BY 1)
SELECT category, {sql_lakhs('a')} AS amount_lakhs, {sql_percent('a', '(SELECT sum(a) FROM p)')} AS share_pct FROM p""", ("v_loans",))
def product_mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_mix(view(spark, sf_dir, "v_loans"), AS_OF)


def annex11(loans: DataFrame, history: DataFrame, as_of: str, k: int = 25) -> DataFrame:
    """The largest non-performing accounts; an unknown sum comes first."""
    bad = latest_assets(history, as_of).where(F.col("asset_code").isin("SUB", "NPA", "DBT", "LOSS", "SMA2"))
    rows = loans.join(bad, F.col("acnt_num") == F.col("account_num"))
    rows = rows.select("acnt_num", L.short_name(F.col("cust_name"), F.col("cust_id")).alias("borrower_name"), F.lit("NA").alias("pan"), L.lakhs(F.col("princ_os")).alias("principal_os"), L.lakhs(F.col("int_due")).alias("int_due"), "asset_code", (F.col("princ_os") + F.col("int_due")).alias("_sum"))
    return top_k(rows, k, F.desc_nulls_first("_sum"), F.asc("acnt_num")).drop("_sum")


@register("annex11_top_npas", f"""WITH {SQL_LATEST} SELECT acnt_num, coalesce(nullif(cust_name, ''), 'Borrower #' || CAST(cust_id AS VARCHAR)) AS borrower_name, 'NA' AS pan, {sql_lakhs('princ_os')} AS principal_os, {sql_lakhs('int_due')} AS int_due, asset_code
FROM v_loans JOIN latest ON acnt_num = account_num WHERE asset_code IN ('SUB', 'NPA', 'DBT', 'LOSS', 'SMA2') ORDER BY princ_os + latest.int_due DESC NULLS FIRST, acnt_num LIMIT 25""", ("v_loans", "v_asset_history"))
def annex11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annex11(view(spark, sf_dir, "v_loans"), view(spark, sf_dir, "v_asset_history"), AS_OF)


#: Income heads as shares of the loan book; a head with a flat amount grows with the period instead.
INCOME_LINES = ((1, "Interest on loans", "0.177", None), (2, "Fees and charges", "0.018", None), (3, "Treasury income", None, "42.50"), (4, "Finance cost", "0.085", None), (5, "Staff cost", "0.038", None), (6, "Profit before tax", "0.072", None))


def income_lines(totals: DataFrame, day_factor: str = "1.00", lines=INCOME_LINES) -> DataFrame:
    """Derived income lines: the scalar loan book against a relation of factors."""
    spark = totals.sparkSession
    factors = spark.createDataFrame(list(lines), "line_no int, head string, factor string, flat string").withColumn("_k", F.lit(1))
    book = totals.select(F.col("total_loan_book").cast("decimal(18,2)").alias("book"), F.lit(1).alias("_k"))
    amount = F.coalesce(F.col("book") * F.col("factor").cast("decimal(6,3)"), F.col("flat").cast("decimal(8,2)") * F.lit(day_factor).cast("decimal(6,2)"))
    return factors.join(book, "_k").select("line_no", "head", F.round(amount, 2).cast("double").alias("amount_lakhs"))


@register("derived_income_lines", f"""WITH t AS (SELECT CAST({sql_lakhs(f'coalesce(sum({OUTSTANDING}), 0)')} AS DECIMAL(18,2)) AS book FROM v_loans WHERE {IN_BOOK}),
f(line_no, head, factor, flat) AS (VALUES {', '.join(f"({n}, '{h}', {f or 'NULL'}, {x or 'NULL'})" for n, h, f, x in INCOME_LINES)})
SELECT line_no, head, CAST(round(CAST(coalesce(book * CAST(factor AS DECIMAL(6,3)), CAST(flat AS DECIMAL(8,2))) AS DECIMAL(28,5)), 2) AS DOUBLE) AS amount_lakhs FROM f, t""", ("v_loans",))
def income_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income_lines(portfolio_totals(view(spark, sf_dir, "v_loans"), AS_OF))


def cells(section: DataFrame, sheet: str, order: list[Column], columns: list[tuple[str, str]], first_row: int = 13) -> DataFrame:
    """(sheet, coord, value): a section's rows laid out from ``first_row``, each column under its letter."""
    ranked = section.withColumn("_row", F.row_number().over(_global(order)) - 1 + first_row)
    at = [F.struct(F.concat(F.lit(letter), F.col("_row").cast("string")).alias("coord"), _cell(F.col(name), dict(section.dtypes)[name]).alias("value")) for letter, name in columns]
    return ranked.select(F.lit(sheet).alias("sheet"), F.explode(F.array(*at)).alias("c")).select("sheet", "c.coord", "c.value")


def _cell(value: Column, kind: str) -> Column:
    return value.cast("decimal(24,2)").cast("string") if kind == "double" else value.cast("string")


def _global(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


@register("report_cells", f"""WITH {SQL_LATEST}, b AS (SELECT {SQL_BUCKET} AS status, count(*) AS n, {sql_lakhs('coalesce(sum(princ_os), 0)')} AS a FROM latest GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY status) + 12 AS r FROM b),
n AS (SELECT coalesce(nullif(cust_name, ''), 'Borrower #' || CAST(cust_id AS VARCHAR)) AS nm, {sql_lakhs('princ_os')} AS p, asset_code, princ_os + latest.int_due AS s, acnt_num FROM v_loans JOIN latest ON acnt_num = account_num WHERE asset_code IN ('SUB', 'NPA', 'DBT', 'LOSS', 'SMA2') ORDER BY s DESC NULLS FIRST, acnt_num LIMIT 25),
m AS (SELECT *, row_number() OVER (ORDER BY acnt_num) + 12 AS r FROM n)
SELECT 'PART8' AS sheet, 'B' || r AS coord, status AS value FROM r UNION ALL SELECT 'PART8', 'C' || r, CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'PART8', 'D' || r, CAST(CAST(a AS DECIMAL(24,2)) AS VARCHAR) FROM r
UNION ALL SELECT 'Annex11', 'B' || r, nm FROM m UNION ALL SELECT 'Annex11', 'D' || r, CAST(CAST(p AS DECIMAL(24,2)) AS VARCHAR) FROM m UNION ALL SELECT 'Annex11', 'F' || r, asset_code FROM m""", ("v_asset_history", "v_loans"))
def cells_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = view(spark, sf_dir, "v_asset_history")
    quality = cells(asset_quality(history, AS_OF), "PART8", [F.asc("status")], [("B", "status"), ("C", "account_count"), ("D", "amount_lakhs")])
    npas = cells(annex11(view(spark, sf_dir, "v_loans"), history, AS_OF), "Annex11", [F.asc("acnt_num")], [("B", "borrower_name"), ("D", "principal_os"), ("F", "asset_code")])
    return quality.unionByName(npas)


PERIODS = (("monthly", "2026-05"), ("monthly", "2024-02"), ("quarterly", "2025-Q4"), ("quarterly", "FY2026-Q1"), ("quarterly", "2025-Q3"), ("yearly", "2025-2026"), ("yearly", "2024"))


@register("fiscal_periods", """WITH p(frequency, period) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in PERIODS) + """),
y AS (SELECT *, CAST(regexp_extract(period, '(\\d{4})', 1) AS BIGINT) AS y, regexp_extract(period, 'Q([1-4])', 1) AS q FROM p),
s AS (SELECT *, CASE frequency WHEN 'monthly' THEN make_date(y, CAST(substr(period, 6, 2) AS BIGINT), 1) WHEN 'quarterly' THEN CASE q WHEN '1' THEN make_date(y, 4, 1) WHEN '2' THEN make_date(y, 7, 1) WHEN '3' THEN make_date(y, 10, 1) ELSE make_date(y + 1, 1, 1) END ELSE make_date(y, 4, 1) END AS start_date FROM y),
e AS (SELECT *, CAST(start_date + CASE frequency WHEN 'monthly' THEN INTERVAL 1 MONTH WHEN 'quarterly' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 YEAR END - INTERVAL 1 DAY AS DATE) AS end_date FROM s)
SELECT frequency, period, start_date, end_date, CAST(date_diff('day', start_date, end_date) + 1 AS INTEGER) AS days, strftime(start_date, '%d/%m/%Y') AS shown FROM e""")
def periods_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(PERIODS), "frequency string, period string")
    rows = rows.withColumn("start_date", periods.period_start(F.col("frequency"), F.col("period"))).withColumn("end_date", periods.period_end(F.col("frequency"), F.col("period")))
    return rows.withColumn("days", periods.duration_days(F.col("start_date"), F.col("end_date"))).withColumn("shown", F.date_format("start_date", "dd/MM/yyyy"))


@register("scheme_titles", """WITH c(code) AS (VALUES ('1610'), ('1601.0'), ('16'), ('1399'), ('101'), ('1001'), ('12.0'), ('77'), (NULL)), t AS (SELECT code, regexp_replace(trim(code), '\\.0$', '') AS x FROM c),
m(k, v) AS (VALUES ('1610', 'MSME Priority Credit Desk'), ('1601', 'Commercial Term Loan Desk'), ('1620', 'Working Capital Loan Desk'), ('1301', 'Microfinance JLG Credit Desk'), ('1302', 'Self-Help Group Credit Desk'), ('101', 'Retail Gold Loan Desk'), ('1001', 'Gold Express Credit Desk'))
SELECT code, CASE WHEN x IS NULL THEN 'Lending Scheme Desk' WHEN v IS NOT NULL THEN v || ' (Scheme #' || x || ')' WHEN x LIKE '16%' THEN 'MSME Credit Desk (Scheme #' || x || ')' WHEN x LIKE '13%' THEN 'Microfinance Desk (Scheme #' || x || ')' WHEN x LIKE '1%' THEN 'Gold Loan Desk (Scheme #' || x || ')' ELSE 'Lending Scheme Desk #' || x END AS title FROM t LEFT JOIN m ON k = x""")
def scheme_titles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = [("1610",), ("1601.0",), ("16",), ("1399",), ("101",), ("1001",), ("12.0",), ("77",), (None,)]
    return spark.createDataFrame(codes, "code string").withColumn("title", L.scheme_title(F.col("code")))
