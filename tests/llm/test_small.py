"""Edge cases of every operator and stage: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bit_packed, co_training, jaccard_join, language_id, license_scan, motion_jpeg, packing, quality_rules, sources_mix, tokens, url_reputation
from ledgerloom.llm.held import held

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size long, _copy int, mix_size long, lang_pred string, n_words long"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", "one", "A b c d e f", "A b c d e f", "!!! 123 ...", "x " * 30_000, "naïve Straße ÀÉ", "(c) 2020 x\nReleased under the MIT Licence.", "a b  c"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 1.0, "k", 1, 1, 1, "p", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "null id text here now", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 0, 0), (6, None, None), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
OPERATORS = {
    "rules": lambda d, l: quality_rules.statistics(d).withColumn("v", quality_rules.verdict(quality_rules.learn_rules(d, l))),
    "packing": lambda d, l: packing.pack(d, tokens.public_path(WORD)),
    "license": lambda d, l: license_scan.scan(d),
    "media": lambda d, l: motion_jpeg.read_back(motion_jpeg.text_media(d)),
    "clips": lambda d, l: motion_jpeg.clips(motion_jpeg.text_media(d)),
    "urls": lambda d, l: url_reputation.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), url_reputation.outcomes_from_labels(l)),
    "jaccard": lambda d, l: jaccard_join.similar(d),
    "files": lambda d, l: bit_packed.read_documents(bit_packed.token_files(d, tokens.public_path(BYTE))),
    "language": lambda d, l: language_id.identify(d, language_id.train(d)),
    "co_training": lambda d, l: co_training.score(d, co_training.train(d, l)),
    "mix": lambda d, l: sources_mix.mix_plan(d),
}
A_ROW_EACH = ("rules", "license", "media", "urls", "jaccard", "files", "language", "co_training", "mix")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    found = OPERATORS[name](odd, labels).collect()
    assert len(found) == odd.count() if name in A_ROW_EACH else found


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.where("false"), labels.where("false")).collect() == []


def test_stages_keep_columns(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert docs is odd or rows == []


def test_defined_results(odd, labels):
    lang = {r.doc_id: r for r in language_id.identify(odd.drop("lang_pred"), language_id.train(odd)).collect()}
    assert [lang[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and lang[0].lang_score == 0
    near = {r.doc_id: r for r in jaccard_join.similar(odd).collect()}
    assert near[5].component_id == 4 and near[0].n_shingles == 0 and near[1].component_id == 1 and near[3].n_shingles == 1 and near[None].component_id is None
    licensed = {r.doc_id: r.license_id for r in license_scan.scan(odd).collect()}
    assert licensed[9] == "MIT notice" and licensed[0] is None
    media = {r.doc_id: r for r in motion_jpeg.read_back(motion_jpeg.text_media(odd)).collect()}
    assert media[0].payload_bytes == 192 and media[0].payload_sha256 == media[1].payload_sha256 and media[4].media_sha256 == media[5].media_sha256


def test_mixed_rows_are_unchanged(odd):
    assert {r.mix_size for r in sources_mix.mix_documents(odd).collect()} <= {1, None}


def test_host_rules(spark):
    pages = spark.createDataFrame([(1, "HTTP://WWW.Example.com/en/x?q"), (2, "https://a.example.com/en/"), (3, "http://x.net/es/1"), (4, "http://notexample.com"), (5, "no url"), (6, None), (7, "https://b.org/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(pages, none).collect()}
    assert found[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert found[2][2:] == ("example.com/en/", "block") and found[3][2:] == ("net/es/", "block")
    assert found[4][:3] == ("notexample.com", "", None) and found[5][:3] == ("", "", None) == found[6][:3] and found[7][2] is None


def test_bad_hosts_are_blocked(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), (F.col("id") % 4).cast("string"), F.lit(".d"), (F.col("id") % 2).cast("string"), F.lit(".org/")).alias("url"))
    outcomes = pages.select("page_id", (~F.col("url").contains("//h3.")).alias("good"))
    verdicts = {(r.host, r.verdict) for r in url_reputation.filter_urls(pages, outcomes, rules=()).collect()}
    assert ("h3.d1.org", "block") in verdicts and ("h0.d0.org", "allow") in verdicts and len(verdicts) == 4


def test_near_copies_keep_one_of_each_group(spark, odd, tmp_path):
    kept = corpus_pipeline.near_copies(spark, odd, str(tmp_path))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *(i for i in range(11) if i != 5)]


def test_a_worker_holds_one_object():
    first = held("a", lambda: [1])
    assert held("a", lambda: [2]) is first and held("b", lambda: [3]) == [3] and held("a", lambda: [4]) == [4]


def test_buckets_of_words():
    """Equal words and shapes have equal buckets, wherever they stand."""
    import pyarrow as pa

    one = co_training._buckets(pa.array(["Hello", "hello", "HELLOO", "x9-", "y7-", "", "aaaaaaaaaaaaaaaaaaaa", "Straße"]))
    assert one[0, 0] == one[1, 0] and one[0, 1] != one[1, 1] and one[3, 1] == one[4, 1] and one[3, 0] != one[4, 0] and one[1, 1] == one[6, 1]
    assert (co_training._buckets(pa.array(["z", "Hello"]))[1] == one[0]).all() and len(co_training._buckets(pa.array([], pa.string()))) == 0


def test_more_languages_than_a_table_holds(spark, monkeypatch):
    """Every label can be predicted, also where scores are summed in several parts."""
    monkeypatch.setattr(language_id, "ALL_WORDS", 400)
    rows = [(i * 250 + j, f"word{j}a {j}x thing{j} same", f"l{j:03d}") for i in range(2) for j in range(250)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(documents)
    assert len(model.languages) == 250 and len(model.words.names) <= 400
    monkeypatch.setattr(language_id, "TABLE", 500)
    found = language_id.identify(documents, model).collect()
    assert sum(r.lang_pred == r.lang for r in found) > 0.95 * len(found)


def test_session_settings_stay(spark, odd, labels):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    quality_rules.learn_rules(odd, labels), jaccard_join.similar(odd).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_damaged_media_reads_back(spark):
    good = motion_jpeg.write_avi(bytes(192))
    media = spark.createDataFrame([(1, 5, None), (2, 5, b"RIFF"), (3, 5, good), (4, 5, good[: len(good) // 3])], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r for r in motion_jpeg.read_back(media).collect()}
    assert found[3].payload_bytes == 192 and found[1].payload_bytes is None and found[2].feature.startswith("error=") and found[4].payload_sha256 is None


def test_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.gov.uk",), ("shop.com.mx",), ("www.example.com",), ("com",), ("",), ("a.b.pages.dev",), ("h.tokyo.jp",)], "host string")
    rule = {r.host: (r.domain, r.suffix) for r in url_reputation.placed(hosts).collect()}
    assert rule["a.b.co.uk"] == ("b.co.uk", "co.uk") and rule["x.gov.uk"] == ("x.gov.uk", "gov.uk") and rule["shop.com.mx"] == ("shop.com.mx", "com.mx") and rule["www.example.com"] == ("example.com", "com") and rule["com"] == ("com", "com") and rule[""] == ("", "")
    known = spark.createDataFrame([("pages.dev",), ("tokyo.jp",), ("uk",), ("b.co.uk",)], "suffix string")
    listed = {r.host: (r.domain, r.suffix) for r in url_reputation.placed(hosts, known).collect()}
    assert listed["a.b.pages.dev"] == ("b.pages.dev", "pages.dev") and listed["h.tokyo.jp"] == ("h.tokyo.jp", "tokyo.jp") and listed["a.b.co.uk"] == ("a.b.co.uk", "b.co.uk") and listed["www.example.com"] == ("example.com", "com")


def test_ties_in_rules_and_classifiers(spark):
    """Equal values and equal scores: the same model and the same rows at every run."""
    rows = [(i, "good words in a line of text here now" if i % 2 else "### ### ###", "en", "s") for i in range(80)]
    documents = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality_rules.learn_rules(documents, labels) == quality_rules.learn_rules(documents.repartition(7), labels)
    kept = [{(r.doc_id, r.quality_kept) for r in co_training.score(documents, co_training.train(d, labels)).collect()} for d in (documents, documents.repartition(5))]
    assert kept[0] == kept[1] == {(i, bool(i % 2)) for i in range(80)}
