from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lending as L
from ledgerloom.functions import periods
from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_periods():
    assert periods.period_range("monthly", "2026-05") == (dt.date(2026, 5, 1), dt.date(2026, 5, 31))
    assert periods.period_range("quarterly", "2025-Q4") == (dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    assert periods.period_range("quarterly", "2026-Q1") == (dt.date(2026, 4, 1), dt.date(2026, 6, 30))
    assert periods.period_range("yearly", "2025-2026") == (dt.date(2025, 4, 1), dt.date(2026, 3, 31))
    assert periods.period_range("yearly", "2025", end=dt.date(2025, 5, 1))[1] == dt.date(2025, 5, 1)
    with pytest.raises(ValueError):
        periods.period_range("weekly", "2025")


def test_names_and_ratios(spark):
    parts = [F.col("f"), F.col("m")]
    row = spark.createDataFrame([("  ", None, None, 7)], "n string, f string, m string, id long")
    assert row.select(L.borrower_name(F.col("n"), parts, F.col("id"))).first()[0] == "Borrower #7"
    assert row.select(L.annex_name(F.nullif("n", F.lit("  ")), parts, F.col("id"))).first()[0] == ""
    assert one(spark, L.asset_bucket(F.col("c")), c="SMA2") == "Doubtful / Loss"


def test_slugs_and_ids(spark):
    assert one(spark, T.slug(F.col("a")), a="A & B") == "a_and_b"
    assert one(spark, T.slug(F.col("a"), ampersand=False), a="A & B") == "a_b"
    import uuid

    assert one(spark, T.url_id(F.col("a")), a="x:1:2") == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:1:2"))


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    words = one(spark, T.word_chunks(F.col("a")), a=text)
    assert [len(c.split()) for c in words] == [500, 500, 100] and words[1].split()[0] == "w450"
    assert one(spark, T.word_chunks(F.col("a")), a="  ") == []
    paragraphs = one(spark, T.paragraph_chunks(F.col("a"), 1800, 250), a="a" * 1000 + "\n\n" + "b" * 1500)
    assert paragraphs[0] == "a" * 1000 and paragraphs[-1].endswith("b")
    assert sum(map(len, paragraphs)) >= 2500
    found = one(spark, T.sections(F.col("a")), a="intro\n## One\nbody\n\n## Two\nmore")
    assert [(s.section, s.body) for s in found] == [("One", "body"), ("Two", "more")]


def test_urls(spark):
    assert one(spark, U.normalize_url(F.col("a")), a="https://x.org/a/?q=1#f") == "https://x.org/a"
    for link, wanted in (("/b", "https://x.org/b"), ("c", "https://x.org/a/c"), ("https://y.org", "https://y.org"), ("//z.org/d", "https://z.org/d")):
        assert one(spark, U.resolve(F.col("l"), F.col("b")), l=link, b="https://x.org/a/i.html") == wanted
    assert one(spark, U.admitted(F.col("a"), F.lit("https://www.x.org")), a="https://x.org:443/a.PDF") is False
