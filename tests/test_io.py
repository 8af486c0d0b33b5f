from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import upserts


def test_text_and_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nURL: https://x.org/a\n\n- **one** line of text\nPowered by y\n")
    (tmp_path / "b.pdf").write_bytes(b"p1\fp2\f \f")
    page = readers.raw_pages(spark, str(tmp_path)).first()
    assert page.url == "https://x.org/a" and page.lines == ["one line of text"]
    found = readers.page_files(spark, str(tmp_path), lambda data: data.decode().split("\f"))
    assert [(r.page, r.text) for r in found.orderBy("page").collect()] == [(1, "p1"), (2, "p2")]


def test_registries(spark, tmp_path):
    for i, p in enumerate(("high", None)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": f"r{i}", "category": "c", "source_docs": ["a.pdf", "b*.pdf"]} | ({"priority": p} if p else {}), indent=1))
    found = readers.regulations(spark, str(tmp_path))
    assert sorted((r.id, r.priority) for r in found.collect()) == [("r0", "high"), ("r1", "medium")]
    with pytest.raises(KeyError):
        readers.one(found, "id", "none")
    files = spark.createDataFrame([("c", "a.pdf", "/a"), ("c", "b1.pdf", "/b1"), ("c", "xb.pdf", "/x"), ("d", "a.pdf", "/d")], "category string, file_name string, path string")
    assert sorted({r.path for r in readers.source_files(found, files).collect()}) == ["/a", "/b1"]


def test_crawl_configs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"institutions": [{"name": "A & B", "start_url": "u"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "z", "qdrant_collection": "q", "max_pages": 5}))
    assert sorted((r.slug, r.collection, r.max_pages) for r in readers.crawl_configs(spark, str(tmp_path)).collect()) == [("a_and_b", "comp_a_and_b", 100), ("z", "q", 5)]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nA='1'\nB=2 # x\nexport C=3\n")
    assert readers.settings(str(tmp_path / ".env"), {"A": "9"}) == {"A": "9", "B": "2", "C": "3"}


def test_writers(spark, tmp_path):
    points = spark.createDataFrame([("c1", 1), ("c2", 2)], "collection string, v int")
    sinks.replace_collections(points, str(tmp_path / "p"))
    sinks.replace_collections(points.where("v = 2").withColumn("v", F.lit(7)), str(tmp_path / "p"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 7]
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, t int")
    sinks.upsert(first, str(tmp_path / "u"), "k", F.col("t"))
    path = sinks.upsert(spark.createDataFrame([("b", 9)], "k string, t int"), str(tmp_path / "u"), "k", F.col("t"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 2), ("b", 9)]
    with pytest.raises(ValueError):
        sinks.register_new(spark.createDataFrame([("A B",)], "name string"), spark.createDataFrame([("a_b",)], "id string"), str(tmp_path / "r"))
    chunks = spark.createDataFrame([("p", 1, 0, "c", "s", "t")], "path string, page int, chunk_index int, collection string, section string, text string")
    assert sinks.stable_ids(chunks).first().point_id == sinks.stable_ids(chunks).first().point_id
    assert len(sinks.content_ids(chunks).first().point_id) == 36


def test_stream_keeps_latest(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = upserts.events(spark, str(tmp_path / "in"), "k string, t int, v string")
    query = upserts.keep_latest(stream, "k", ["t"], str(tmp_path / "out"), str(tmp_path / "cp"))
    found = upserts.drain(query, lambda: upserts.latest(spark, str(tmp_path / "out"), "k", ["t"]))
    assert sorted((r.k, r.v) for r in found.collect()) == [("a", "y"), ("b", "z")]
