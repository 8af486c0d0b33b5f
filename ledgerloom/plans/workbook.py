"""The return as a workbook: the fixed lines, the summary, and every sheet's cells as rows.

A cell is (sheet, coord, value, wrap).  Sections are laid out from row 13, a
letter a column; a sheet that holds a list is blanked first, so rows of an older
return don't show through, and merged cells of a template stay as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import periods
from ledgerloom.operators.relational import union_all
from ledgerloom.plans import details as D
from ledgerloom.plans import returns as R
from ledgerloom.plans.domain import view
from ledgerloom.plans.registry import ORACLES, register, sql_lakhs
from ledgerloom.storage import materialize

# The capital lines (code, particulars, lakhs), before the period's capital factor.
CAPITAL_LINES = (
    ("1.1", "Paid-up Equity Capital", "2500.00"), ("1.2", "Free Reserves & Statutory Reserve Fund", "1450.00"), ("1.3", "Share Premium Account", "800.00"),
    ("1.4", "Total Owned Funds (1.1 + 1.2 + 1.3)", "4750.00"), ("1.5", "Less: Investments in Group Companies", "150.00"), ("1.6", "Net Owned Funds (NOF)", "4600.00"),
)
# Sensitive sectors (name, lakhs before the capital factor, share of the book, risk weight in percent).
SENSITIVE_LINES = (("Real Estate & Commercial Mortgages", "420.00", None, 100.0), ("Capital Markets & Mutual Funds", "430.00", None, 125.0), ("MSME Commercial Desk", None, "0.650", 75.0))
# The capital adequacy in percent, what a period of 31 days adds, and the most it adds.
CRAR, CRAR_STEP, CRAR_MOST = "24.8", "0.1", "2.0"
STANDARD_PROVISION = "0.004"
#: Text over this length is wrapped.
WRAPPED = 25
PERIOD = ("quarterly", "2000-Q1")
GENERATED = "2000-07-01 00:00:00"


def period_row(spark: SparkSession, frequency: str, period: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """One row: the dates, and the factors that scale flows and capital."""
    first, last = periods.period_range(frequency, period, start, end)
    row = spark.createDataFrame([(frequency, period, first, last)], "frequency string, period string, start_date date, end_date date")
    day, flow, capital = periods.scaled(F.col("start_date"), F.col("end_date"))
    return row.withColumn("day_factor", day).withColumn("flow_factor", flow).withColumn("capital_factor", capital)


def capital_lines(period: DataFrame, lines: Sequence[tuple] = CAPITAL_LINES) -> DataFrame:
    """(line_no, code, particulars, amount_lakhs): the lines times the capital factor."""
    rows = period.sparkSession.createDataFrame([(i, *line) for i, line in enumerate(lines)], "line_no int, code string, particulars string, flat string").withColumn("_k", F.lit(1))
    amount = F.round(F.col("flat").cast("decimal(12,2)") * F.col("capital_factor"), 2).cast("double")
    return rows.join(period.withColumn("_k", F.lit(1)), "_k").select("line_no", "code", "particulars", amount.alias("amount_lakhs"))


def sensitive_lines(period: DataFrame, totals: DataFrame, lines: Sequence[tuple] = SENSITIVE_LINES) -> DataFrame:
    """(line_no, sector, exposure_lakhs, risk_weight_pct): flat lines times the capital factor, others a share of the book."""
    rows = period.sparkSession.createDataFrame([(i, *line) for i, line in enumerate(lines)], "line_no int, sector string, flat string, share string, risk_weight_pct double").withColumn("_k", F.lit(1))
    both = rows.join(period.withColumn("_k", F.lit(1)), "_k").join(totals.withColumn("_k", F.lit(1)), "_k")
    amount = F.coalesce(F.col("flat").cast("decimal(12,2)") * F.col("capital_factor"), F.col("total_loan_book").cast("decimal(18,2)") * F.col("share").cast("decimal(6,3)"))
    return both.select("line_no", "sector", F.round(amount, 2).cast("double").alias("exposure_lakhs"), "risk_weight_pct")


def summary(period: DataFrame, totals: DataFrame, ratio: DataFrame) -> DataFrame:
    """One row: book, net owned funds, capital adequacy and the non-performing share (null for an empty book)."""
    k = F.lit(1)
    funds = capital_lines(period).where("code = '1.6'").select(F.col("amount_lakhs").alias("net_owned_funds"), k.alias("_k"))
    crar = F.round(F.lit(CRAR).cast("decimal(6,2)") + F.least(F.col("day_factor") * F.lit(CRAR_STEP).cast("decimal(4,2)"), F.lit(CRAR_MOST).cast("decimal(6,4)")), 1).cast("double")
    days = periods.duration_days(F.col("start_date"), F.col("end_date"))
    parts = period.select("frequency", "period", "start_date", "end_date", days.alias("duration_days"), crar.alias("crar_pct"), k.alias("_k"))
    return parts.join(totals.select("total_loan_book", k.alias("_k")), "_k").join(funds, "_k").join(ratio.select("npa_ratio_pct", k.alias("_k")), "_k").drop("_k")


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("decimal(24,2)").cast("string") if kind == "double" else F.col(name).cast("string")


def listed(section: DataFrame, sheet: str, columns: Sequence[tuple[str, str]], *order: Column, first_row: int = 13, numbered: str | None = None, constants: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """A section's rows from ``first_row`` on, each column under its letter; ``numbered`` has the row's number, ``constants`` the same text in each row."""
    rows = section.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # a report's rows
    at = lambda letter: F.concat(F.lit(letter), (F.col("_n") + (first_row - 1)).cast("string"))
    cell = lambda letter, value: F.struct(at(letter).alias("coord"), value.alias("value"))
    each = [cell(letter, _text(section, name)) for letter, name in columns] + [cell(letter, F.lit(text)) for letter, text in constants] + ([cell(numbered, F.col("_n").cast("string"))] if numbered else [])
    return rows.select(F.lit(sheet).alias("sheet"), F.explode(F.array(*each)).alias("c")).select("sheet", "c.*")


def single(row: DataFrame, sheet: str, cells: Sequence[tuple[str, Column]]) -> DataFrame:
    """Cells of a one-row relation."""
    each = F.array(*[F.struct(F.lit(coord).alias("coord"), value.cast("string").alias("value")) for coord, value in cells])
    return row.select(F.lit(sheet).alias("sheet"), F.explode(each).alias("c")).select("sheet", "c.*")


def at_least(section: DataFrame, sheet: str, cells: Sequence[tuple[str, str, Sequence[int]]], least: int, *order: Column) -> DataFrame:
    """Cells (coord, column, row numbers from 0 that are added up) of a section with ``least`` rows or more; none of a shorter one."""
    rows = section.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)
    kind = dict(section.dtypes)
    total = lambda name, at: F.sum(F.when(F.col("_n").isin(*at), F.col(name).cast("decimal(24,2)" if kind[name] == "double" else "long"))).cast("string")
    each = [F.struct(F.lit(coord).alias("coord"), total(name, at).alias("value")) for coord, name, at in cells]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("c")).where(F.col("n") >= least).select(F.lit(sheet).alias("sheet"), F.explode("c").alias("c")).select("sheet", "c.*")


def blank(spark: SparkSession, sheet: str, rows: int, columns: int, first_row: int = 13) -> DataFrame:
    """Empty cells of a rectangle that begins in column B."""
    letters = F.explode(F.array(*[F.lit(chr(ord("B") + i)) for i in range(columns)]))
    return spark.range(rows).select(F.lit(sheet).alias("sheet"), (F.col("id") + first_row).cast("string").alias("_r"), letters.alias("_l")).select("sheet", F.concat("_l", "_r").alias("coord"), F.lit(None).cast("string").alias("value"))


def workbook(values: DataFrame, blanks: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(sheet, coord, value, wrap): values over blanks; coordinates that a template has merged (sheet, coord) are left out."""
    key = ["sheet", "coord"]
    cells = values.unionByName(blanks.join(values.select(*key), key, "left_anti"))
    cells = cells if merged is None else cells.join(merged.select(*key).distinct(), key, "left_anti")
    return cells.withColumn("wrap", F.coalesce(F.length("value") > WRAPPED, F.lit(False)))


#: Sheets that hold lists: rows and columns that are blanked.
LISTS = {"Annex2": (30, 6), "Annex9": (40, 11), "Annex10": (30, 7), "Annex11": (30, 13), "Annex13": (30, 9)}
SHEETS = ("PART1", "PART2", "PART3", "PART4", "PART6", "PART8", "PART8A", "PART8C", *LISTS)


def report(spark: SparkSession, loans: DataFrame, customers: DataFrame, history: DataFrame, investments: DataFrame, shares: DataFrame, period: DataFrame, as_of: str, generated: str, merged: DataFrame | None = None) -> DataFrame:
    """All sheets of the return for a period.

    Eight sheets read the loan book and several its totals, so these are
    written once instead of computed for each.
    """
    loans = materialize(loans, "return-loans")
    totals, quality = materialize(R.portfolio_totals(loans, as_of), "return-totals"), materialize(R.asset_quality(history, as_of), "return-quality")
    whole = materialize(summary(period, totals, R.npa_ratio(quality, totals)), "return-summary")
    money = lambda c: F.col(c).cast("decimal(24,2)")
    frequency = F.initcap("frequency")
    filing = single(period, "FilingInfo", [
        ("B2", F.concat(F.lit("Period: "), F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string"), F.lit(" ("), frequency, F.lit(")"))),
        ("B3", F.lit(f"Generated Date: {generated}")), ("C11", frequency), ("C12", periods.shown_date(F.col("start_date"))), ("C13", periods.shown_date(F.col("end_date"))), ("C15", F.lit("LAKHS")), ("C16", F.lit("1.0.0")),
    ])
    heads = period.select(F.explode(F.array(*[F.lit(s) for s in SHEETS])).alias("sheet"), F.lit("B5").alias("coord"), F.concat(F.lit("Reporting Period End Date :"), periods.upper_date(F.col("end_date"))).alias("value"))
    day = F.col("day_factor").cast("decimal(6,2)")
    income = R.income_lines(totals, period.select(day.cast("string")).first()[0])
    mix = [("C14", "amount_lakhs", (0,)), ("C15", "amount_lakhs", (1, 2)), *[(f"C{13 + i}", "amount_lakhs", (i,)) for i in (3, 4, 5)]]
    bands = [(f"{letter}{17 + i}", name, (i,)) for i in range(3) for letter, name in (("C", "account_count"), ("D", "amount_lakhs"), ("G", "avg_interest_rate"))]
    branches = D.annex13_named(spark, loans, as_of).withColumn("district", F.replace("branch_name", F.lit(" Virtual Branch"), F.lit("")))
    values = union_all(
        filing, heads,
        listed(capital_lines(period), "PART1", [("C", "amount_lakhs")], F.asc("line_no")),
        single(whole, "PART2", [("C13", money("total_loan_book"))]), at_least(R.product_mix(loans, as_of), "PART2", mix, 6, F.desc("amount_lakhs"), F.asc("category")),
        at_least(income, "PART3", [(f"C{14 + i}", "amount_lakhs", (i,)) for i in range(6)], 6, F.asc("line_no")),
        single(whole, "PART4", [("C13", money("net_owned_funds"))]),
        at_least(sensitive_lines(period, totals), "PART6", [(f"C{14 + i}", "exposure_lakhs", (i,)) for i in range(3)], 3, F.asc("line_no")),
        listed(quality, "PART8", [("B", "status"), ("C", "account_count"), ("D", "amount_lakhs"), ("E", "provision_lakhs")], F.asc("status")),
        at_least(R.msme_bands(loans, as_of), "PART8A", bands, 3, F.asc("band_no")),
        single(whole, "PART8C", [("C14", money("total_loan_book")), ("D14", F.round(money("total_loan_book") * F.lit(STANDARD_PROVISION).cast("decimal(4,3)"), 2))]),
        listed(R.shareholders(shares), "Annex2", [("B", "name"), ("C", "type_of_capital"), ("E", "num_shares"), ("F", "face_value"), ("G", "shareholding_pct")], F.desc("shareholding_pct"), F.asc("name"), constants=[("D", "NA")]),
        listed(R.annex9(loans, customers, history, as_of), "Annex9", [("C", "borrower_name"), ("D", "pan"), ("E", "borrower_type"), ("F", "sanctioned_amt"), ("G", "disbursed_amt"), ("I", "principal_outstanding"), ("J", "accrued_interest"), ("K", "account_status"), ("L", "total_outstanding")], F.desc("total_outstanding"), F.asc("acnt_num"), numbered="B", constants=[("H", "0.00")]),
        listed(R.annex10(investments), "Annex10", [("B", "entity_name"), ("C", "nature"), ("D", "investment_type"), ("E", "pan"), ("F", "book_value"), ("G", "is_group_company"), ("H", "amt_outstanding")], F.desc("amt_outstanding"), F.asc("inv_id")),
        listed(R.annex11(loans, history, as_of), "Annex11", [("C", "borrower_name"), ("D", "pan"), ("E", "principal_os"), ("F", "int_due"), ("G", "asset_code")], F.asc("acnt_num"), numbered="B"),
        listed(branches, "Annex13", [("C", "branch_name"), ("G", "district"), ("H", "customer_count"), ("I", "account_count"), ("J", "total_outstanding")], F.desc("total_outstanding"), F.asc("branch_code"), numbered="B", constants=[("D", "Virtual District Branch Office"), ("E", "District Desk"), ("F", "Karnataka")]),
    )
    return workbook(values, union_all(*[blank(spark, sheet, *size) for sheet, size in LISTS.items()]), merged)


START, END = "DATE '2000-04-01'", "DATE '2000-06-30'"
SQL_PERIOD = f"""d AS (SELECT CAST(round((date_diff('day', {START}, {END}) + 1)::DOUBLE / 31, 2) AS DECIMAL(12,2)) AS f), m AS (SELECT f, CAST(least(greatest(1 + (f - 1) * 0.15, 1.0), 2.5) AS DECIMAL(12,4)) AS c FROM d),
t AS (SELECT CAST({sql_lakhs(f'coalesce(sum({R.OUTSTANDING}), 0)')} AS DECIMAL(24,2)) AS book FROM v_loans WHERE {R.IN_BOOK})"""
SQL_CAPITAL = ", ".join(f"({i}, '{c}', '{p}', {x})" for i, (c, p, x) in enumerate(CAPITAL_LINES))
SQL_SENSITIVE = ", ".join(f"({i}, '{n}', CAST({x or 'NULL'} AS DECIMAL(12,2)), CAST({s or 'NULL'} AS DECIMAL(6,3)), {w}::DOUBLE)" for i, (n, x, s, w) in enumerate(SENSITIVE_LINES))


def _period(spark: SparkSession) -> DataFrame:
    return period_row(spark, *PERIOD)


@register("part1_capital", f"WITH {SQL_PERIOD}, l(line_no, code, particulars, flat) AS (VALUES {SQL_CAPITAL}) SELECT line_no, code, particulars, CAST(round(CAST(flat AS DECIMAL(12,2)) * c, 2) AS DOUBLE) AS amount_lakhs FROM l, m", ("v_loans",))
def capital_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capital_lines(_period(spark))


@register("part6_sensitive", f"WITH {SQL_PERIOD}, l(line_no, sector, flat, share, risk_weight_pct) AS (VALUES {SQL_SENSITIVE}) SELECT line_no, sector, CAST(round(coalesce(flat * c, book * share), 2) AS DOUBLE) AS exposure_lakhs, risk_weight_pct FROM l, m, t", ("v_loans",))
def sensitive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive_lines(_period(spark), R.portfolio_totals(view(spark, sf_dir, "v_loans"), R.AS_OF))


@register("part3_income_scaled", f"WITH {SQL_PERIOD}, l(line_no, head, factor, flat) AS (VALUES {', '.join(f"({n}, '{h}', CAST({f or 'NULL'} AS DECIMAL(6,3)), CAST({x or 'NULL'} AS DECIMAL(8,2)))" for n, h, f, x in R.INCOME_LINES)}) SELECT line_no, head, CAST(round(coalesce(book * factor, flat * f), 2) AS DOUBLE) AS amount_lakhs FROM l, m, t", ("v_loans",))
def income_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The income lines of a quarter: the treasury line grows with the period."""
    day = _period(spark).select(F.col("day_factor").cast("string")).first()[0]
    return R.income_lines(R.portfolio_totals(view(spark, sf_dir, "v_loans"), R.AS_OF), day)


@register("return_summary", f"WITH q AS ({ORACLES['npa_ratio']}), d AS (SELECT CAST(round((date_diff('day', {START}, {END}) + 1)::DOUBLE / 31, 2) AS DECIMAL(12,2)) AS f) SELECT 'quarterly' AS frequency, '2000-Q1' AS period, {START} AS start_date, {END} AS end_date, CAST(date_diff('day', {START}, {END}) + 1 AS INTEGER) AS duration_days, total_loan_book, CAST(round(4600.00 * least(greatest(1 + (f - 1) * 0.15, 1.0), 2.5), 2) AS DOUBLE) AS net_owned_funds, CAST(round(24.8 + least(f * 0.1, 2.0), 1) AS DOUBLE) AS crar_pct, npa_ratio_pct FROM q, d")
def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = R.portfolio_totals(view(spark, sf_dir, "v_loans"), R.AS_OF)
    return summary(_period(spark), totals, R.npa_ratio(R.asset_quality(view(spark, sf_dir, "v_asset_history"), R.AS_OF), totals))


def _sql_money(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(24,2)) AS VARCHAR)"


def _sql_list(sheet: str, source: str, order: str, cells: Sequence[tuple[str, str]]) -> str:
    coords, values = ", ".join(f"'{letter}' || (n + 12)" for letter, _ in cells), ", ".join(value for _, value in cells)
    return f"SELECT '{sheet}' AS sheet, unnest([{coords}]) AS coord, unnest([{values}]) AS value FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM ({source}) x) y"


def _sql_lines(sheet: str, source: str, first: int, column: str, least: int) -> str:
    return f"SELECT '{sheet}' AS sheet, 'C' || ({first} + n) AS coord, {_sql_money(column)} AS value FROM (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS n, count(*) OVER () AS k FROM ({source}) x) y WHERE k >= {least} AND n < {least}"


SQL_CELLS = " UNION ALL ".join([
    f"SELECT 'FilingInfo' AS sheet, unnest(['B2', 'B3', 'C11', 'C12', 'C13', 'C15', 'C16']) AS coord, unnest(['Period: 2000-04-01 to 2000-06-30 (Quarterly)', 'Generated Date: {GENERATED}', 'Quarterly', '01/04/2000', '30/06/2000', 'LAKHS', '1.0.0']) AS value",
    f"SELECT unnest([{', '.join(repr(s) for s in SHEETS)}]), 'B5', 'Reporting Period End Date :30-JUN-2000'",
    _sql_lines("PART1", ORACLES["part1_capital"], 13, "amount_lakhs", 6),
    f"SELECT 'PART2', 'C13', {_sql_money('total_loan_book')} FROM ({ORACLES['return_summary']}) x",
    f"SELECT 'PART2', unnest(['C14', 'C15', 'C16', 'C17', 'C18']), unnest([{', '.join(_sql_money(x) for x in ('a[1]', 'a[2] + a[3]', 'a[4]', 'a[5]', 'a[6]'))}]) FROM (SELECT list(amount_lakhs ORDER BY amount_lakhs DESC, category) AS a FROM ({ORACLES['part2_product_mix']}) x) y WHERE len(a) >= 6",
    _sql_lines("PART3", ORACLES["part3_income_scaled"], 14, "amount_lakhs", 6),
    f"SELECT 'PART4', 'C13', {_sql_money('net_owned_funds')} FROM ({ORACLES['return_summary']}) x",
    _sql_lines("PART6", ORACLES["part6_sensitive"], 14, "exposure_lakhs", 3),
    _sql_list("PART8", ORACLES["part8_asset_quality"], "status", [("B", "status"), ("C", "CAST(account_count AS VARCHAR)"), ("D", _sql_money("amount_lakhs")), ("E", _sql_money("provision_lakhs"))]),
    f"SELECT 'PART8A', unnest(['C' || r, 'D' || r, 'G' || r]), unnest([CAST(account_count AS VARCHAR), {_sql_money('amount_lakhs')}, {_sql_money('avg_interest_rate')}]) FROM (SELECT *, 16 + row_number() OVER (ORDER BY band_no) AS r, count(*) OVER () AS k FROM ({ORACLES['part8a_msme_bands']}) x) y WHERE k >= 3",
    f"SELECT 'PART8C', unnest(['C14', 'D14']), unnest([{_sql_money('total_loan_book')}, CAST(CAST(round(CAST(total_loan_book AS DECIMAL(24,2)) * 0.004, 2) AS DECIMAL(24,2)) AS VARCHAR)]) FROM ({ORACLES['return_summary']}) x",
    _sql_list("Annex2", ORACLES["annex2_shareholders"], "shareholding_pct DESC, name", [("B", "name"), ("C", "type_of_capital"), ("D", "'NA'"), ("E", "CAST(num_shares AS VARCHAR)"), ("F", _sql_money("face_value")), ("G", _sql_money("shareholding_pct"))]),
    _sql_list("Annex9", ORACLES["annex9_top_borrowers"], "total_outstanding DESC, acnt_num", [("B", "CAST(n AS VARCHAR)"), ("C", "borrower_name"), ("D", "pan"), ("E", "borrower_type"), ("F", _sql_money("sanctioned_amt")), ("G", _sql_money("disbursed_amt")), ("H", "'0.00'"), ("I", _sql_money("principal_outstanding")), ("J", _sql_money("accrued_interest")), ("K", "account_status"), ("L", _sql_money("total_outstanding"))]),
    _sql_list("Annex10", ORACLES["annex10_investments"], "amt_outstanding DESC, inv_id", [("B", "entity_name"), ("C", "nature"), ("D", "investment_type"), ("E", "pan"), ("F", _sql_money("book_value")), ("G", "is_group_company"), ("H", _sql_money("amt_outstanding"))]),
    _sql_list("Annex11", ORACLES["annex11_top_npas"], "acnt_num", [("B", "CAST(n AS VARCHAR)"), ("C", "borrower_name"), ("D", "pan"), ("E", _sql_money("principal_os")), ("F", _sql_money("int_due")), ("G", "asset_code")]),
    _sql_list("Annex13", ORACLES["annex13_named"], "total_outstanding DESC, branch_code", [("B", "CAST(n AS VARCHAR)"), ("C", "branch_name"), ("D", "'Virtual District Branch Office'"), ("E", "'District Desk'"), ("F", "'Karnataka'"), ("G", "replace(branch_name, ' Virtual Branch', '')"), ("H", "CAST(customer_count AS VARCHAR)"), ("I", "CAST(account_count AS VARCHAR)"), ("J", _sql_money("total_outstanding"))]),
])
SQL_BLANKS = " UNION ALL ".join(f"SELECT '{sheet}' AS sheet, chr(CAST(66 + c AS INTEGER)) || (13 + r) AS coord FROM range({rows}) a(r), range({columns}) b(c)" for sheet, (rows, columns) in LISTS.items())


@register("report_workbook", f"WITH cells AS MATERIALIZED ({SQL_CELLS}), blanks AS ({SQL_BLANKS}), whole AS (SELECT * FROM cells UNION ALL SELECT b.sheet, b.coord, NULL FROM blanks b WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.sheet = b.sheet AND c.coord = b.coord)) SELECT sheet, coord, value, coalesce(length(value) > 25, FALSE) AS wrap FROM whole WHERE NOT (sheet = 'Annex9' AND coord IN ('B13', 'C13'))")
def workbook_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet for a quarter, over a template with two merged cells."""
    views = [view(spark, sf_dir, f"v_{name}") for name in ("loans", "customers", "asset_history", "investments", "shares")]
    merged = spark.createDataFrame([("Annex9", "B13"), ("Annex9", "C13")], "sheet string, coord string")
    return report(spark, *views, _period(spark), R.AS_OF, GENERATED, merged)
