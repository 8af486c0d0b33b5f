"""Findings of reviews: searches by id, what the driver holds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.llm import jaccard_join
from ledgerloom.plans import briefs, documents, graph


@pytest.mark.parametrize("ids, shown", [((1231, 11231, 11231), {"CUST-1231", "ACNT-1", "DISB-1-1", "REPAY-1-1"}), ((11231, 30), set())])
def test_customer_search_shows_the_customer_of_that_id(spark, monkeypatch, ids, shown):
    """Neither a customer whose id contains the term, nor the whole book where nobody has it."""
    loans = spark.createDataFrame([(i + 1, c, "Ann", 16, "1", 1231, 100.0, 100.0, 10.0, 9.0, None) for i, c in enumerate(ids)], "acnt_num long, cust_id long, cust_name string, prod_code int, schm_code string, brn_code int, sanc_amt double, lndisb_amt double, pri_repay_amt double, int_rate double, sanc_date date")
    customers = spark.createDataFrame([(c, "1231", None, "Roe") for c in sorted(set(ids))], "cust_id long, first_name string, middle_name string, last_name string")
    monkeypatch.setattr(graph, "view", lambda spark, sf_dir, name: {"v_loans": loans, "v_customers": customers}[name])
    assert {r.id for r in graph.customer_query(spark, "").collect()} == shown


def test_id_filter_comes_to_the_driver_compressed(spark, monkeypatch):
    """16 MB of bits, nearly all 0."""
    ids, came = spark.range(0, 2000, 1, 2).select(F.col("id").alias("v")), []
    collect = type(ids).collect
    monkeypatch.setattr(type(ids), "collect", lambda self: came.extend(rows := collect(self)) or rows)
    bits = jaccard_join._filter(ids)
    at = jaccard_join._filter_bit(np.arange(2000))
    assert all(bits[at >> 3] >> (7 - (at & 7)) & 1) and np.unpackbits(bits).sum() == len(set(at.tolist()))
    assert sum(len(r["bits"]) for r in came) < 1 << 20


def test_paragraph_windows_clean_a_text_once(spark):
    """Not in each of the fold's rounds, of which a text of n characters has n / 150."""
    column = T.paragraph_chunks(F.col("text"))
    assert str(column).count("{3,}") == 1
    texts = ["", " \n\n\n ", None, "a" * 1800, "é" * 5000, "\n\n\n".join("ab " * 200 for _ in range(40)), "x" * 500 + "\n\n" + "y" * 1400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.c for r in df.select("i", column.alias("c")).orderBy("i").collect()] == [None if t is None else windows(t) for t in texts]


def windows(text, size=1800, overlap=250, least=400):
    t, start, out = re.sub(r"\n{3,}", "\n\n", text).strip(), 0, []
    while start < len(t):
        end = min(start + size, len(t))
        if start + size < len(t) and t.rfind("\n\n", start, end) - start > least:
            end = t.rfind("\n\n", start, end)
        out += [t[start:end].strip()] if t[start:end].strip() else []
        start = len(t) if end == len(t) else max(end - overlap, start + 1)
    return out


def test_quadrants_split_a_text_once(spark):
    """Not at each line and part that is looked at."""
    assert str(documents._parts_of(F.col("text"), documents.HEADINGS)).count("split(") == 1
    assert str(documents.four_part_brief(F.col("text"))).count("split(") == 1


def test_profile_reads_the_documents_once_and_cleans_only_the_best(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([(1, "a worthless line of some thirty letters", "s")], "doc_id long, text string, source string")
    lines = documents.extracted_lines(docs, documents.CATEGORIES)
    assert "size(filter(" not in plan(lines)
    links = spark.createDataFrame([], "link_no int, label string, url string")
    found = briefs.full_profile("B", "u", lines, links)
    assert "LogicalRDD [doc_id" not in plan(found) and "- a worthless line of some thirty letters" in found.first().profile


def test_embedding_takes_tokens_in_slices():
    """A batch of 10,000 rows is millions of tokens."""
    sizes = [documents.SLICE_TOKENS - 1, 2, 0, 3 * documents.SLICE_TOKENS, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([*[["t"] * n for n in sizes], None])], names=["doc_id", "tokens"])
    found = list(documents._token_slices([batch]))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert [b.num_rows for b in found] == [1, 2, 1, 3]
