"""Column expressions of the loan book and the return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAKH = 100_000
# Titles of scheme codes and the prefixes behind them.
SCHEME_TITLES = {
    "1610": "MSME Priority Credit Desk", "1601": "Commercial Term Loan Desk", "1620": "Working Capital Loan Desk", "1301": "Microfinance JLG Credit Desk",
    "1302": "Self-Help Group Credit Desk", "101": "Retail Gold Loan Desk", "1001": "Gold Express Credit Desk",
}
SCHEME_PREFIXES = (("16", "MSME Credit Desk"), ("13", "Microfinance Desk"), ("1", "Gold Loan Desk"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def borrower_name(name: Column, parts: list[Column], cust_id: Column) -> Column:
    """The account's name, else the customer's, else a label; blanks count as missing."""
    return F.coalesce(blank_to_null(name), blank_to_null(F.concat_ws(" ", *parts)), F.concat(F.lit("Borrower #"), cust_id.cast("string")))


def annex_name(name: Column, parts: list[Column], acnt: Column) -> Column:
    """The annex's chain: blank names stay, and a customer without names gives an empty one."""
    return F.coalesce(F.nullif(name, F.lit("")), F.trim(F.concat_ws(" ", *parts)), F.concat(F.lit("Account #"), acnt.cast("string")))


def short_name(name: Column, cust_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Borrower #"), cust_id.cast("string")))


def disbursed(disbursement: Column, sanctioned: Column, zero_is_missing: bool) -> Column:
    """Effective disbursement: drill-down counts 0 as missing, the return does not."""
    return F.coalesce(F.nullif(disbursement, F.lit(0)) if zero_is_missing else disbursement, sanctioned)


def outstanding(disbursement: Column, sanctioned: Column, repaid: Column) -> Column:
    return F.coalesce(disbursement, sanctioned) - F.coalesce(repaid, F.lit(0))


def lakhs(amount: Column, digits: int = 2) -> Column:
    """A decimal amount in lakhs, divided and rounded once, as double."""
    return F.round(amount.cast("decimal(24,2)") / F.lit(LAKH).cast("decimal(6,0)"), digits).cast("double")


def mixed_lakhs(amount: Column, over: int = 10_000) -> Column:
    """Amounts over ``over`` are in rupees and become lakhs, others are lakhs already."""
    return F.round(F.when(amount > over, amount.cast("decimal(24,2)") / F.lit(LAKH).cast("decimal(6,0)")).otherwise(amount.cast("decimal(24,2)")), 2).cast("double")


def account_status(code: Column) -> Column:
    return F.when(code.isin("STD", "SMA0"), "Standard").otherwise(F.coalesce(code, F.lit("Standard")))


def asset_bucket(code: Column) -> Column:
    """Everything unnamed, SMA2 and null too, is the last bucket."""
    return F.when(code.isin("STD", "SMA0"), "Standard").when(code == "SMA1", "SMA-1").when(code.isin("SUB", "NPA"), "Sub-Standard").otherwise("Doubtful / Loss")


def provision_rate(bucket: Column) -> Column:
    return F.when(bucket.contains("Sub-Standard"), F.lit("0.150")).when(bucket.contains("Doubtful"), F.lit("1.000")).otherwise(F.lit("0.004")).cast("decimal(4,3)")


def size_band(amount: Column) -> Column:
    amount = F.coalesce(amount, F.lit(0))
    return F.when(amount <= 2_500_000, "Micro").when(amount <= 10_000_000, "Small").otherwise("Medium")


def product_label(code: Column) -> Column:
    return F.when(code == 16, "MSME Loans").when(code == 13, "Microfinance Loans").when(code == 1, "Gold Loans").otherwise(F.concat(F.lit("Other Loans (Product "), F.coalesce(code.cast("string"), F.lit("0")), F.lit(")")))


def head_nature(head: Column) -> Column:
    return F.when(head.ilike("%MUTUAL%"), "Mutual Fund").when(head.ilike("%CURRENT%"), "Current").otherwise("Long Term")


def head_type(head: Column) -> Column:
    return F.when(head.ilike("%DEBENTURE%"), "Debentures").when(head.ilike("%DEPOSIT%"), "Deposits").otherwise("Equity")


def plain_code(code: Column) -> Column:
    """A code as text without a trailing .0."""
    return F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")


def scheme_title(code: Column) -> Column:
    text = plain_code(code)
    titles = F.create_map(*[F.lit(x) for pair in SCHEME_TITLES.items() for x in pair])
    out = F.when(text.isNull(), F.lit("Lending Scheme Desk")).when(titles[text].isNotNull(), F.concat(titles[text], F.lit(" (Scheme #"), text, F.lit(")")))
    for prefix, title in SCHEME_PREFIXES:
        out = out.when(text.startswith(prefix), F.concat(F.lit(f"{title} (Scheme #"), text, F.lit(")")))
    return out.otherwise(F.concat(F.lit("Lending Scheme Desk #"), text))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def in_month(date: Column, month: str) -> Column:
    """The date lies in the month ``yyyy-MM``; a range, so that it reaches the scan."""
    first = F.to_date(F.lit(f"{month}-01"))
    return (date >= first) & (date < F.add_months(first, 1))


def lifecycle(month: Column, growth: Column, legacy_before: str, peak: str) -> Column:
    return F.when(month < legacy_before, "Legacy Book Run-off").when(month == peak, "Peak Origination").when(growth > 0, "Expansion Phase").otherwise("Stabilization")


def counted(n: Column) -> Column:
    """1,234"""
    return F.format_number(n, 0)


def money(amount: Column) -> Column:
    """A rupee amount without its fraction, grouped by thousands."""
    return F.concat(F.lit("₹"), F.format_number(amount.cast("decimal(24,2)"), 0))


def shown_percent(value: Column) -> Column:
    return F.concat(F.format_number(value.cast("decimal(18,4)"), 1), F.lit("%"))


def signed_percent(value: Column) -> Column:
    """A change in percent with its sign."""
    return F.concat(F.when(value >= 0, "+").otherwise(""), F.round(value.cast("decimal(18,4)"), 1).cast("decimal(18,1)").cast("string"), F.lit("%"))


#: Kinds of graph node and how their ids begin.
ID_PREFIXES = {"product": "ZONE-PROD", "branch": "BRN", "scheme": "SCHM", "customer": "CUST", "account": "ACNT", "disbursement": "DISB", "repayment": "REPAY"}


def id_parts(node_id: Column) -> Column:
    """(kind, code, second) of a graph id; a scheme's second part is its code, a payment's its number."""
    kind = F.lit(None).cast("string")
    for name, prefix in ID_PREFIXES.items():
        kind = F.when(node_id.startswith(f"{prefix}-"), name).otherwise(kind)
    rest = F.split(F.regexp_replace(node_id, "^(ZONE-PROD|[A-Z]+)-", ""), "-")
    return F.struct(kind.alias("kind"), F.get(rest, F.lit(0)).alias("code"), F.get(rest, F.lit(1)).alias("second"))
