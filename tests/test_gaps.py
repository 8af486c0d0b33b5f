"""Smaller operators: names, links, periods, formats, briefs, retrieval, graph requests, readers and writers."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.functions import lending as L
from ledgerloom.functions import periods
from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.plans import briefs, details, documents, graph, portfolio, retrieval, state, workbook
from ledgerloom.sources import readers, sinks


def column(spark, values, expression):
    """The expression over a column ``a`` of these values."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, a string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def mended(line):
    try:
        return line.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return line


def test_text(spark):
    a = F.col("a")
    lines = ["cafÃ© â‚¬ 5", "café", "plain", "ß»", "Ã", "â€œquotedâ€\x9d", "naÃ¯ve\x81", "–dash", "𝒜 Ã©", "Ãƒ", ""]
    assert column(spark, lines, T.repaired(a)) == [mended(x) for x in lines]
    assert column(spark, ["# [Ã©t](u) **b** <i>x</i>  y", "![p](q) 12. z"], T.clean_line(a)) == ["ét b x y", "z"]
    paths = ["/a b.html", "/x.html/y", "/café-é.aspx", "/", "//a//b/", "/._x_.", '/q?*:|"<>', "/" + "y" * 200]
    assert column(spark, paths, T.safe_file_name(a)) == ["a b.md", "x_y.md", "café-é.md", "index.md", "a__b.md", "x.md", "q.md", "y" * 150 + ".md"]
    names = ["o'neil a1b x-y_z", "ÉCOLE 3d", ""]
    assert column(spark, names, T.title_case(a)) == [x.title() for x in names]
    assert column(spark, ["about-us_x.md", "plain"], T.stem_label(a)) == ["About Us X", "Plain"]
    assert column(spark, [" :.-Loans -. ", "--"], T.strip_marks(a)) == ["Loans", ""]
    assert column(spark, ["", "C:\\d\\f.pdf", None], T.source_name(a, F.lit("x/y.md"))) == ["y.md", "f.pdf", "y.md"]
    assert column(spark, ["Basel III", "reg_x"], T.collection_name(a)) == ["reg_basel_iii", "reg_x"]
    assert column(spark, ["a/b\\c.md"], T.file_part(a)) == ["c.md"]


def test_links_resolve_like_browsers(spark):
    bases = ("https://x.org/a/i.html", "https://x.org/a/b/", "http://x.org", "http://x.org/a?q=1#f")
    links = ("../b", "./c", "?q=1", "#z", "", "/r/../s", "//h.org/k", "http://o/p", "../../../t", "d//e", ".", "..", "a/./b/../c?x=/../y#z", "mailto:x@y", "b/")
    pairs = spark.createDataFrame([(link, base) for base in bases for link in links], "link string, base string")
    assert all(r.x == urljoin(r.base, r.link) for r in pairs.select("*", U.resolve(F.col("link"), F.col("base")).alias("x")).collect())


def test_periods_and_formats(spark):
    assert periods.period_range("quarterly", "2025-Q9") == (dt.date(2025, 1, 1), dt.date(2025, 3, 31))
    assert periods.period_range("custom", "x", default=periods.DEFAULT_PERIOD) == (dt.date(2026, 5, 1), dt.date(2026, 5, 31))
    assert periods.period_range("custom", "x", end=dt.date(2026, 5, 9), default=periods.DEFAULT_PERIOD)[1] == dt.date(2026, 5, 9)
    with pytest.raises(ValueError):
        periods.period_range("monthly", "May")
    spans = [(dt.date(2000, 4, 1), dt.date(2000, 6, 30)), (dt.date(2000, 1, 1), dt.date(2000, 1, 5)), (dt.date(1999, 4, 1), dt.date(2000, 3, 31)), (dt.date(2000, 1, 9), dt.date(2000, 1, 1))]
    rows = spark.createDataFrame(spans, "s date, e date").select("s", "e", *[c.cast("double") for c in periods.scaled(F.col("s"), F.col("e"))], periods.upper_date(F.col("e")), periods.shown_date(F.col("e"))).collect()
    for r in rows:
        assert tuple(r)[2:5] == pytest.approx(periods.scale_factors(r.s, r.e)) and tuple(r)[5:] == (r.e.strftime("%d-%b-%Y").upper(), r.e.strftime("%d/%m/%Y"))
    a = F.col("a").cast("double")
    assert column(spark, ["1234567.4", "0"], L.money(a)) == ["₹1,234,567", "₹0"] and column(spark, ["95.24"], L.shown_percent(a)) == ["95.2%"]
    assert column(spark, ["1", "-0.25", "0"], L.signed_percent(a)) == ["+1.0%", "-0.3%", "+0.0%"]
    ids = column(spark, ["ZONE-PROD-16", "SCHM-7-1610", "CUST-5", "DISB-9-1", "x"], L.id_parts(F.col("a")))
    assert [tuple(p) for p in ids[:4]] == [("product", "16", None), ("scheme", "7", "1610"), ("customer", "5", None), ("disbursement", "9", "1")] and ids[4].kind is None


def test_card_functions(spark):
    a = F.col("a")
    assert column(spark, ["ada king", "ß x", "", "  ", "one"], briefs.initials(a)) == ["AK", "SS", "U", "U", "O"]
    assert column(spark, ["₹ 1,200.50", "n/a", "7%"], briefs.amount(a)) == [1200.5, None, 7.0]
    assert [tuple(x) for x in column(spark, ["[FACT] b", "c"], briefs.labelled(a))] == [("FACT", "b"), (None, "c")]
    assert column(spark, ["b"], briefs.policy_key(F.array(F.lit("z"), F.col("a")), F.lit(None).cast("string"))) == ["policy:b,z:"]


def test_brief_blocks(spark):
    text = "RISK WATCH: credit (Report, p.3) rises [FACT] here\n- one\n2. two\n\n* three\n### Applicability\nSO WHAT\n**Bold head**\nplain (Source: Doc, page 4) text"
    found = documents.brief_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("doc_id", "block").collect()
    assert [(r.kind, r.text) for r in found if r.doc_id == 1] == [("heading", "RISK WATCH"), ("paragraph", "credit (Report, p.3) rises here"), ("bullets", "one\ntwo"), ("bullets", "three"), ("heading", "Applicability"), ("heading", "SO WHAT"), ("heading", "Bold head"), ("paragraph", "plain (Source: Doc, page 4) text")]
    assert [r.citations for r in found if r.citations] == [["Report, p.3"], ["Doc, page 4"]] and [r.text for r in found if r.interpretive] == ["SO WHAT"] and {r.doc_id for r in found} == {1}


def test_swot(spark):
    text = "x\nStrengths\n- a\n  * b\nno bullet\nTHREATS:\n- c\nStrengths\n- d\nStrategic observation: it\n grows\n\nfast"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert sorted((r.quadrant, r["items"]) for r in documents.quadrants(rows).collect()) == [("strengths", ["a", "b", "d"]), ("threats", ["c"])]
    assert rows.where("doc_id = 1").select(documents.observation(F.col("text"))).first()[0] == "it grows fast"


def test_frontier_is_not_cut(spark):
    """Pages more than ten links away, loops, and a limit by site."""
    edges = spark.createDataFrame([(f"https://a.org/{i}", f"https://a.org/{i + 1}") for i in range(14)] + [("https://a.org/3", "https://a.org/0"), ("https://a.org/1", "https://b.org/0"), ("https://b.org/0", "https://b.org/1")], "src string, dst string")
    seeds = spark.createDataFrame([("https://a.org/0",)], "id string")
    found = {r.id: r.depth for r in documents.frontier(edges, seeds).collect()}
    assert found["https://a.org/14"] == 14 and found["https://b.org/1"] == 3 and len(found) == 17
    few = documents.frontier(edges, seeds, most_pages=2, site=U.net_location(F.col("id"))).collect()
    assert sorted(r.id for r in few) == ["https://a.org/0", "https://a.org/1", "https://b.org/0", "https://b.org/1"]


def test_hash_embedding_of_each_text(spark):
    import hashlib
    import math
    import re
    from collections import Counter

    texts = ["a b a C", "", None, "x" * 9 + " y1 y1 y1"]
    rows = documents.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).collect()
    wanted = {}
    for i, text in enumerate(texts):
        n = Counter(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 16 for t in re.findall("[a-z0-9]+", (text or "").lower()))
        wanted |= {(i, b): v / math.sqrt(sum(x * x for x in n.values())) for b, v in n.items()}
    assert {(r.doc_id, r.bucket): r.weight for r in rows} == pytest.approx(wanted)


def test_context_by_lengths(spark):
    """The same blocks with and without a key, ties and texts over the budget included."""
    hits = spark.createDataFrame([(i, "s" if i % 3 else "t", "x" * (7 * i % 23), None if i % 2 else i) for i in range(40)], "doc_id int, source string, text string, page int")
    parts = [sorted(map(tuple, retrieval.context(hits, ["source"], 100, F.asc("doc_id"), key=key).collect())) for key in (None, "doc_id")]
    assert parts[0] == parts[1] and parts[0][0][2].startswith("[s]\n") and "[t p.6]" in parts[0][1][2]
    assert column(spark, ["", "None", None, "7"], retrieval.block_label(F.lit("d"), F.col("a"), spelt=True)) == ["[Source: d]"] * 3 + ["[Source: d, p.7]"]


def test_ask_and_retrieve(spark):
    hits = spark.createDataFrame([("d", "A long sentence that says what is asked for, and then says a bit more of it.", 0.9), ("e", "weak", 0.1)], "source string, text string, score double")

    def broken(prompt, context):
        raise TimeoutError

    assert briefs.ask(hits, "q", lambda p, c: f"{p}|{c}", extra=["E"])["answer"].startswith("q|E\n\n[d]\nA long")
    assert briefs.ask(hits, "q", broken, degraded="later")["answer"] == "later"
    with pytest.raises(TimeoutError):
        briefs.ask(hits, "q", broken)
    assert briefs.ask(hits, "q", least=2.0, nothing="none")["answer"] == "none"
    with pytest.raises(LookupError):
        briefs.ask(hits, "q", least=2.0)
    extra = retrieval.registry_context(spark.createDataFrame([(1, "K", None, None, None)], "id int, name string, priority string, effective_date string, applicability string"), spark.createDataFrame([], "id int, severity string, title string, category string, summary string, action_required string"))
    assert briefs.ask(hits, "q", least=2.0, extra=extra)["context"] == "[regulatory registry]\nTracked regulations, with their priority:\n- K: priority medium"
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id int, text string")
    assert [r.doc_id for r in retrieval.retrieve(chunks, 1, question="alpha").collect()] == [1]
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, 1)


def test_graph_requests(spark):
    R = graph.Request
    assert [R().tier, R(None, zonal_id="z").tier, R(None, zonal_id="z", manager_id="m").tier, R("manager", agent_id="a").tier, R(None, manager_id="m", agent_id="a").tier, R(None, agent_id="a", customer_id="c").tier, R(None).tier] == ["executive", "zonal", "manager", "manager", "agent", "customer", None]
    loans = spark.createDataFrame([(1, 10, "Ann", 16, "1", 7, 100.0, 100.0, 10.0, 9.0, None), (2, 11, None, 13, "2", 8, 50.0, 0.0, None, 9.0, dt.date(2000, 1, 1))], "acnt_num long, cust_id long, cust_name string, prod_code int, schm_code string, brn_code int, sanc_amt double, lndisb_amt double, pri_repay_amt double, int_rate double, sanc_date date")
    customers = spark.createDataFrame([(11, "Bob", None, "Roe")], "cust_id long, first_name string, middle_name string, last_name string")
    shown = lambda *a: {r.id for r in graph.graph_view(spark, loans, customers, *a)[0].collect()}
    assert shown() == {"EXEC-PORTFOLIO", "ZONE-PROD-16", "ZONE-PROD-13"}
    assert shown(R(None, customer_id="11")) == {"CUST-11", "ACNT-2", "DISB-2-1", "REPAY-2-1"} == shown(R(), "roe")
    assert shown(R(None, agent_id="SCHM-8-2")) == {"BRN-8", "SCHM-8-2", "CUST-11"}
    assert shown(R(), "ann") == {"CUST-10", "ACNT-1", "DISB-1-1", "REPAY-1-1"} and shown(R(), "nobody") == shown()
    assert shown(R(None)) == set() and shown(R(None, customer_id="99")) == set()
    assert portfolio.search(loans, customers, "a", least=2).count() == 0 < portfolio.search(loans, customers, "an", least=2).count()
    hub = spark.createDataFrame([("h", f"n{i}") for i in range(9)], "source string, target string")
    row = portfolio.adjacency(hub, 4).where("id = 'h'").first()
    assert row.degree == 9 and row.neighbours == "n0,n1,n2,n3"


def test_workbook_parts(spark):
    section = spark.createDataFrame([("b", 2.0), ("a", 1.5)], "name string, amount double")
    assert workbook.at_least(section, "S", [("C1", "amount", (0, 1))], 3, F.asc("name")).collect() == []
    assert workbook.at_least(section, "S", [("C1", "amount", (0, 1))], 2, F.asc("name")).first().value == "3.50"
    values = workbook.listed(section, "S", [("C", "name"), ("D", "amount")], F.asc("name"), numbered="B")
    cells = {r.coord: r.value for r in workbook.workbook(values, workbook.blank(spark, "S", 3, 3), spark.createDataFrame([("S", "C13")], "sheet string, coord string")).collect()}
    assert cells == {"B13": "1", "D13": "1.50", "B14": "2", "C14": "b", "D14": "2.00", "B15": None, "C15": None, "D15": None}


def test_state_and_details(spark):
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("9"))
    assert spark.range(1).select(details.overlay(base, over)).first()[0] == {"a": "1", "b": "9"}
    registry = spark.createDataFrame([("c1", "A"), ("c2", "B")], "collection string, name string")
    assert [r.collection for r in state.existing_collections(registry, spark.createDataFrame([("c2",), ("c2",)], "collection string")).collect()] == ["c2"]


def test_readers_and_writers(spark, tmp_path):
    path = str(tmp_path / "points")
    chunks = spark.createDataFrame([("c", "x"), ("c", "x")], "collection string, text string")
    sinks.append_points(chunks, path), sinks.append_points(chunks, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 == stored.select("point_id").distinct().count()
    sinks.create_if_missing(chunks, str(tmp_path / "one")), sinks.create_if_missing(chunks.limit(0), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2
    index = spark.createDataFrame([("1", "c", "d", None, None, 3, 0, "s", "t"), ("2", "k", "d", None, None, None, 1, "s", "u")], "id string, collection string, document string, source string, path string, page int, chunk_index int, section string, text string")
    sinks.json_lines(index, str(tmp_path / "index"))
    assert [r.text for r in readers.chunk_index(spark, str(tmp_path / "index"), "k").collect()] == ["u"] and readers.chunk_index(spark, str(tmp_path / "index")).count() == 2
    pages = spark.createDataFrame([("bank", "T", "https://x.org/a/b.html", "body"), ("bank", "U", "https://x.org/", "more")], "slug string, title string, url string, body string")
    sinks.markdown(pages, str(tmp_path / "md"))
    written = {f.parent.name: f.read_text() for f in (tmp_path / "md").rglob("*.txt")}
    assert written["file=a_b.md"].startswith("# T\n\nURL: https://x.org/a/b.html\n\nbody") and set(written) == {"file=a_b.md", "file=index.md"}
    sinks.register_new(spark.createDataFrame([("New Bank", "coop")], "name string, type string"), spark.createDataFrame([("old",)], "id string"), str(tmp_path / "reg"))
    assert [(r.id, r.name) for r in readers.registry(spark, str(tmp_path / "reg")).collect()] == [("new_bank", "New Bank")]
    for t in range(4):
        sinks.upsert(spark.createDataFrame([("a", t)], "k string, t int"), str(tmp_path / "v"), "k", F.col("t"))
    assert len(sinks.drop_old_versions(spark, str(tmp_path / "v"), 2)) == 2 and len(list((tmp_path / "v").iterdir())) == 2
    (tmp_path / "alerts.json").write_text(json.dumps([{"title": "t", "severity": "high"}]))
    assert readers.static_rows(spark, str(tmp_path / "alerts.json"), readers.ALERT).first().severity == "high"


def test_jdbc_needs_a_driver(spark, tmp_path):
    """The reader asks Spark for the table; without a driver on the class path Spark says so."""
    sqlite3.connect(tmp_path / "x.db").close()
    with pytest.raises(Exception, match="(?i)driver"):
        readers.jdbc_table(spark, f"jdbc:sqlite:{tmp_path}/x.db", "t", {}, key="id", bounds=(0, 10), parts=2)


def test_intermediate_tables_can_be_released(spark):
    mark = storage.written()
    table = storage.materialize(spark.range(3), "t")
    assert table.count() == 3 and storage.written() == mark + 1
    storage.release(mark)
    assert storage.written() == mark
