"""A loan book and its sidelines derived from the driver's tables.

Each view is one SELECT that Spark and DuckDB read alike; ``{table}`` stands
for a base table.  Nulls, blanks, zeros and ties are put in on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_loans": """
SELECT o.o_orderkey AS acnt_num, o.o_custkey AS cust_id,
       CASE WHEN o.o_custkey % 10 = 0 THEN '  ' WHEN o.o_custkey % 11 = 0 THEN NULL ELSE c.c_name END AS cust_name,
       CASE o.o_orderstatus WHEN 'P' THEN 16 WHEN 'O' THEN 13 ELSE 1 END AS prod_code,
       substr(o.o_orderpriority, 1, 1) AS schm_code, c.c_nationkey AS brn_code,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 40 AS DECIMAL(18,2)) AS sanc_amt,
       CASE WHEN o.o_orderkey % 50 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(d.disb * 40 AS DECIMAL(18,2)) END AS lndisb_amt,
       CAST(d.repay * 40 AS DECIMAL(18,2)) AS pri_repay_amt,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(10 + o.o_custkey % 12 AS DOUBLE) END AS int_rate,
       CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS sanc_date
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS disb,
                  SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS repay
           FROM {lineitem} GROUP BY l_orderkey) d ON d.l_orderkey = o.o_orderkey""",
    "v_customers": """
SELECT c_custkey AS cust_id, CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE substr(c_name, 1, 8) END AS first_name,
       CAST(NULL AS VARCHAR(10)) AS middle_name, CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE substr(c_name, 10) END AS last_name
FROM {customer}""",
    "v_asset_history": """
SELECT l_orderkey AS account_num, CAST(l_shipdate AS DATE) AS effective_date,
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE
         CASE l_linenumber WHEN 1 THEN 'STD' WHEN 2 THEN 'SMA0' WHEN 3 THEN 'SMA1' WHEN 4 THEN 'SMA2' WHEN 5 THEN 'SUB' WHEN 6 THEN 'NPA' ELSE 'DBT' END END AS asset_code,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 40 AS DECIMAL(18,2)) AS princ_os,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS int_due,
       CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS charg_due,
       l_partkey AS tiebreak_1, l_suppkey AS tiebreak_2, l_linenumber AS tiebreak_3
FROM {lineitem}""",
    "v_investments": """
SELECT p_partkey AS inv_id, p_name AS entity_name, CASE WHEN p_size <= 25 THEN 'CURRENT' ELSE NULL END AS investment_nature,
       p_type AS investment_type, CAST(NULL AS VARCHAR(10)) AS pan,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 1 END AS DECIMAL(18,2)) AS book_value,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CASE WHEN p_partkey % 3 = 0 THEN 50 ELSE 1 END AS DECIMAL(18,2)) END AS amount_outstanding,
       p_partkey % 7 = 0 AS is_group_company
FROM {part}""",
    "v_gl_heads": """
SELECT CAST(s_suppkey AS VARCHAR(20)) AS access_code,
       CASE WHEN s_suppkey % 6 = 0 THEN 'Mutual fund ' WHEN s_suppkey % 6 = 1 THEN 'Share holding ' WHEN s_suppkey % 6 = 2 THEN 'Investment debenture '
            WHEN s_suppkey % 6 = 3 THEN 'Investment deposit ' ELSE 'Salary ' END || s_name AS head_descn
FROM {supplier}""",
    "v_gl_balances": "SELECT CAST(s_suppkey AS VARCHAR(20)) AS glacc_code, s_nationkey AS branch_code, CAST(s_acctbal AS DECIMAL(18,2)) AS bc_bal FROM {supplier}",
    "v_shares": """
SELECT CASE WHEN c_nationkey = 0 THEN NULL ELSE n_name END AS share_customer_name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 100 + 1 END AS no_of_units,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(10 AS DECIMAL(18,2)) END AS face_value
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_points": "SELECT vec_id AS point_id, 'col_' || CAST(label AS VARCHAR(10)) AS collection, embedding FROM {embeddings}",
    "v_brief_log": "SELECT event_id AS seq, 'v3:' || event_type || ':' || CAST(user_id AS VARCHAR(20)) AS cache_key, props AS payload, ts AS generated_at FROM {events}",
    "v_review_log": """
SELECT event_id AS seq, user_id AS item_id, CASE event_type WHEN 'error' THEN 'flagged' WHEN 'view' THEN 'reviewed' ELSE 'pending' END AS status, props AS note, ts AS reviewed_at
FROM {events} WHERE event_type IN ('error', 'view', 'signup')""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bases = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))
    return spark.sql(VIEWS[name], **{b: table(spark, sf_dir, b) for b in bases})


def cte(names: Iterable[str], sql: str) -> str:
    """DuckDB SQL with the named views in front of a query (which may begin with WITH)."""
    heads = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in names]
    if not heads:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(heads)}" + (", " + body[4:] if body[:5].upper() == "WITH " else "\n" + body)
