from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import relational as R
from ledgerloom.plans import retrieval
from ledgerloom.plans.documents import frontier, quadrants


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_as_of_ties_and_nulls(spark):
    history = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-02-01", "b"), (1, "2024-02-01", "c"), (1, None, "d"), (2, "2024-05-01", "e")], "k int, d string, v string").withColumn("d", F.to_date("d"))
    assert [r.v for r in R.latest_as_of(history, "k", "d", "2024-03-01", [F.desc("v")]).collect()] == ["c"]
    assert R.latest_as_of(history.limit(0), "k", "d", "2024-03-01").count() == 0


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z"), (None, 1, "n")], "k int, at int, l string")
    right = spark.createDataFrame([(1, 2, "p"), (1, 5, "q"), (1, 6, "r"), (2, None, "s")], "k int, d int, v string")
    assert rows(R.as_of_join(left, right, "k", "at", "d").select("l", "v")) == [("n", None), ("x", "q"), ("y", None), ("z", None)]


def test_late_admitted_duplicates(spark):
    """A text under the threshold for one query is kept at a later query's score; a passing first hit beats a better later one."""
    hits = spark.createDataFrame([(1, 1, "a", 0.40), (2, 1, "a", 0.50), (1, 2, "b", 0.50), (2, 2, "b", 0.90)], "query_id int, hit_rank int, text string, score double")
    assert rows(retrieval.multi_query_fusion(hits, "text", 0.45, 12).select("text", "score")) == [("a", 0.5), ("b", 0.5)]


def test_budget_cuts_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "o int, n int")
    assert [r.o for r in R.prefix_budget(df.withColumn("g", F.lit(1)), ["g"], F.col("n"), 10, F.asc("o")).collect()] == [1]


def test_growth_and_shares(spark):
    df = spark.createDataFrame([("1", 0), ("2", 10), ("3", 15)], "m string, v int")
    assert [r.g for r in R.growth(df, "v", "m", "g").orderBy("m").collect()] == [0.0, 0.0, 50.0]
    assert sum(r.s for r in R.share_of_total(df, "v", "s").collect()) == 100.0
    assert R.share_of_total(df.where("v = 0"), "v", "s").first().s == 0.0


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(KeyError):
        R.require_known(a, b, "k")
    with pytest.raises(ValueError):
        R.require_unique(a, "k")
    with pytest.raises(ValueError):
        retrieval.bounded(spark.range(5), 4)


def test_frontier_and_quadrants(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(frontier(links, spark.createDataFrame([("a",)], "id string"))) == [("a", 0), ("b", 1), ("c", 2)]
    brief = spark.createDataFrame([(1, "## Strengths\n- one\n- two\n**Threats**\n- three\nrest")], "doc_id int, text string")
    assert rows(quadrants(brief)) == [(1, "strengths", ["one", "two"]), (1, "threats", ["three"])]


def test_briefs(spark):
    from ledgerloom.plans import briefs

    hits = spark.createDataFrame([("s", "A sentence that is long enough to be counted as one of the long sentences here.", 0.9), ("t", "x", 0.1)], "source string, text string, score double")
    said = briefs.ask(hits, "q")
    assert said["answer"].startswith("A sentence") and "[t]" not in said["context"]
    assert briefs.ask(hits, "q", lambda prompt, context: prompt.upper())["answer"] == "Q"
    with pytest.raises(LookupError):
        briefs.ask(hits, "q", least=0.95)
    state = spark.createDataFrame([("v3:a", "old", "2024-01-01 00:00:00")], "cache_key string, payload string, g string").select("cache_key", "payload", F.col("g").cast("timestamp_ntz").alias("generated_at"))
    assert briefs.cached(state, "a", lambda: "new", "2024-01-01 10:00:00")[0] == "old"
    made, after = briefs.cached(state, "a", lambda: "new", "2024-01-01 13:00:00")
    assert made == "new" and [r.payload for r in after.collect()] == ["new"]
    assert briefs.cached(state, "b", lambda: None, "2024-01-01 13:00:00")[1] is state
    import pandas as pd

    assert [r.embedding for r in briefs.embed(hits, lambda texts: pd.Series([[1.0]] * len(texts))).collect()] == [[1.0], [1.0]]
