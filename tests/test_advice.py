"""Whole results beyond the sizes of the test tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.plans import retrieval
from ledgerloom.plans.documents import HEADINGS, quadrants_query


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_queries_beyond_one_block(spark):
    """Every query gets its best k by brute force, whatever the number of blocks, and beyond the bound of one."""
    vectors = np.random.default_rng(3).normal(size=(60, 4)).round(2)
    points = spark.createDataFrame([(i, f"col_{i % 3}", v.tolist()) for i, v in enumerate(vectors)], "point_id long, collection string, embedding array<double>").repartition(3)
    queries = points.select(F.col("point_id").alias("query_id"), "embedding")
    blocks = list(retrieval.query_blocks(queries.repartition(4), 7))
    assert len(blocks) >= 9 and max(map(len, blocks)) <= 7 and sorted(r.query_id for b in blocks for r in b) == list(range(60))
    for per in (False, True):
        wanted = []
        for q in range(60):
            for among in ([[i for i in range(60) if i % 3 == c] for c in range(3)] if per else [range(60)]):
                best = sorted(among, key=lambda i: (-float(vectors[q] @ vectors[i]), i))[:2]
                wanted += [(q, i, n + 1) for n, i in enumerate(best)]
        for block in (7, 60, 100):
            found = retrieval.dense_topk(points, queries, 2, per, block=block)
            assert rows(found.select("query_id", "point_id", "hit_rank")) == sorted(wanted, key=repr)


def test_more_queries_than_the_old_bound(spark):
    queries = spark.range(10_500).select(F.col("id").alias("query_id"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("embedding"))
    points = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.5])], "point_id long, collection string, embedding array<double>")
    found = retrieval.dense_topk(points, queries, 1)
    assert found.count() == 10_500 and {r.point_id for r in found.where("query_id % 2 = 0").collect()} == {2}


def test_briefs_hold_all_lines(spark, tmp_path):
    """Every line of a document is an item of a quadrant, as a brute-force parser finds them."""
    texts = ["a\nb\nc\nd\ne\nf\ng\nh\ni", "one", "", "x\n\n  y\n- z\nThreats here\n### Strengths\n* w", "p\nq", "\n".join(f"line {i}" for i in range(5_000)), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = []
    for i, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        for q, heading in enumerate(HEADINGS):
            items = [re.sub(r"^\s*[-*•]\s+", "", f"- {line}") for line in lines[len(lines) * q // 4 : len(lines) * (q + 1) // 4]]
            if items:
                wanted.append((i, heading.lower(), len(items), hashlib.md5("|".join(items).encode()).hexdigest()))
    assert rows(quadrants_query(spark, str(tmp_path))) == sorted(wanted, key=repr)


def test_federated_search_of_each_query(spark):
    """A text that one query has seen is no copy for another one, and each query has its own best."""
    hits = spark.createDataFrame([(1, 0, 1, "a", 0.5), (1, 1, 1, "a", 0.9), (1, 1, 2, "b", 0.8), (2, 1, 1, "a", 0.7), (2, 2, 1, "c", 0.6), (2, 2, 2, "d", 0.1)], "query_id int, collection_no int, hit_rank int, text string, score double")
    assert rows(retrieval.federated([hits], 2, ["query_id"]).select("query_id", "text", "score")) == [(1, "a", 0.5), (1, "b", 0.8), (2, "a", 0.7), (2, "c", 0.6)]
