"""Operators that SQL can't express, against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bit_packed, co_training, jaccard_join, language_id, motion_jpeg, packing, quality_rules, queries, tokens
from ledgerloom.llm.components import components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    found = queries.QUERIES[name](spark, DATA)
    wanted = con.sql(queries.ORACLES[name])
    at = [wanted.columns.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_rule_counts(spark, texts):
    for r in queries.QUERIES["op1_quality_rules"](spark, DATA).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_rules_find_a_planted_threshold():
    rng = np.random.default_rng(0)
    x = {"symbols_a_word": rng.random(3000), "word_length": rng.random(3000)}
    bad = (x["symbols_a_word"] > 0.7) & (x["word_length"] <= 0.5)
    rules = quality_rules.learn(x, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= quality_rules._covers(rule, x, 3000)
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.02 * (~bad).sum()
    assert quality_rules.learn(x, rng.random(3000) < 0.2) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piecewise_ids_are_the_tokenizers(texts, name):
    odd = ["", "  a  b\n c", "a\n\nb  c ", "hello <|endoftext|> world", "it's, they're. we'LL don't,", "Straße Ünïcode, é. ٣,", "\x01 a\x01b", "a\x1c b \x85 c", "ΑΣ. Σ, .. ,", "\n\n", "1,2. 3.", " lead", "trail ", "a​, ​b.", "a  b"]
    encoder = tokens.PieceEncoder(tokens.public_path(name), kept=100)
    assert encoder.kind != "whole"
    for _ in range(2):
        many = odd + list(texts.values())
        offsets, ids = encoder.encode(pa.array(many))
        whole = encoder.tokenizer.encode_batch(many, add_special_tokens=False)
        assert all(ids[offsets[i] : offsets[i + 1]].tolist() == e.ids for i, e in enumerate(whole))


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 3, 11, 16, 17, 29, 32):
        ids = rng.integers(0, 2**width, 10_000, dtype=np.uint64).astype(np.uint32)
        lengths = np.array([0, 1, 5_000, 4_999])
        data = bit_packed.write_file([5, None, 7, 9], lengths, ids, width, block=1000)
        f = bit_packed.PackedFile(data)
        assert (f.read(0, f.n_ids) == ids).all() and (f.document(2) == ids[1:5001]).all() and (f.read(4321, 4323) == ids[4321:4323]).all() and len(f.document(0)) == 0
    assert bit_packed.width_for(50257) == 16 and bit_packed.width_for(1) == 1


def test_token_files(spark, texts):
    encoder = tokens.encoder(tokens.public_path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(queries.QUERIES["op7_bit_packed_ids"](spark, DATA).collect(), key=lambda r: r.doc_id):
        ids = np.array([*encoder.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, texts, documents):
    encoder = tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    ids = {i: np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    pieces = queries.QUERIES["op2_mixture_packing"](spark, DATA).toPandas()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in pieces.itertuples())
    for key, first in ((["doc_id"], "start"), (["sequence_id"], "offset")):
        ordered = pieces.sort_values([*key, first])
        assert (ordered.groupby(key).length.cumsum() - ordered.length == ordered[first]).all()
    assert pieces.length.sum() == sum(map(len, ids.values()))
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled.iloc[:-1] == 4096).all() and list(filled.index) == list(range(len(filled)))
    sources = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    check_turns(pieces, {i: (sources[i], len(x)) for i, x in ids.items()}, lambda totals: {s: n**packing.TEMPER for s, n in totals.items()}, packing.QUANTUM)


def check_turns(pieces, documents: dict, weigh, quantum: int) -> None:
    """The stream's units are those of a round-robin that always serves the queue whose credit came first."""
    queues: dict = defaultdict(list)
    for r in pieces[pieces.start == 0].sort_values(["row_part", "row_no"]).itertuples():
        source, n = documents[r.doc_id]
        queues[source] += [(r.doc_id, k, min(quantum, n - k)) for k in range(0, n, quantum)]
    weights = weigh({s: sum(n for _, _, n in q) for s, q in queues.items()})
    heap = [(0.0, s is not None, s) for s in queues]
    heapq.heapify(heap)
    given, at, wanted = Counter(), Counter(), []
    while heap:
        _, named, s = heapq.heappop(heap)
        wanted.append(queues[s][at[s]])
        given[s] += wanted[-1][2]
        at[s] += 1
        if at[s] < len(queues[s]):
            heapq.heappush(heap, (given[s] / weights[s], named, s))
    stream = pieces.sort_values(["sequence_id", "offset"])
    units = stream.groupby(["row_part", "row_no"], sort=False).agg(doc_id=("doc_id", "first"), start=("start", "min"), length=("length", "sum"))
    assert list(units.itertuples(index=False, name=None)) == wanted


@pytest.mark.parametrize("weights", [None, {"a": 0.2, "b": 0.5, None: 0.3}])
def test_packing_by_weights(spark, weights):
    """Targets other than the sources' own shares: queues run dry, a source without a weight comes last, ids repeat and are null."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "c"]), "word " * rng.randint(0, 90)) for i in range(300)]
    path = tokens.public_path("word_bpe_49k.json")
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3, "doc_id"), path, 64, weights=weights, quantum=32).toPandas()
    documents = {i: (s, t.count("word") + 1) for i, s, t in rows}
    late = sum(n for s, n in documents.values() if s == "c") if weights else 0
    if weights:
        stream = pieces.sort_values(["sequence_id", "offset"])
        last = stream.doc_id.map(lambda i: documents[i][0] == "c")
        assert last.sum() and last.iloc[-last.sum() :].all() and stream[last].length.sum() == late
        kept = pieces[~pieces.doc_id.map(lambda i: documents[i][0] == "c")]
        check_turns(kept, {i: d for i, d in documents.items() if d[0] != "c"}, lambda totals: weights, 32)
        first = stream[stream.sequence_id < 20].assign(source=lambda p: p.doc_id.map(lambda i: str(documents[i][0]))).groupby("source").length.sum()
        assert abs(first["b"] / first.sum() - 0.5) < 0.05 and abs(first["a"] / first.sum() - 0.2) < 0.05
    else:
        check_turns(pieces, documents, lambda totals: totals, 32)
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled.iloc[:-1] == 64).all() and pieces.length.sum() == sum(n for _, n in documents.values())
    assert pieces.sort_values("sequence_id").padded_length.iloc[-1] == packing.padded(int(filled.iloc[-1]), 64)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(spark.createDataFrame(pieces.drop(columns="ids").assign(ids=[bytes(x) for x in pieces.ids]))).collect()}
    assert all(len(whole[k]) == n for k, n in filled.items())


def test_many_sources_pack(spark):
    """A source a document: nothing about sources comes to the driver."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id")).alias("source"), F.lit("a b c").alias("text"))
    pieces = packing.pack(rows, tokens.public_path("word_bpe_49k.json"), 64).collect()
    assert sum(r.length for r in pieces) == 12_000 and {r.doc_id for r in pieces} == set(range(3000))


def test_media_round_trip():
    rng = random.Random(2)
    for n in (192, 384, 192 * 40):
        data = bytes(rng.randrange(256) for _ in range(n))
        avi = motion_jpeg.read_avi(motion_jpeg.write_avi(data, 16))
        frames = [motion_jpeg.decode_frame(f) for f in avi.frames]
        assert motion_jpeg.payload(avi, frames) == data
        slow = motion_jpeg.Frame(frames[0].width, frames[0].height, frames[0].components, frames[0].tables, [])
        raw = bytes(avi.frames[0])
        start = raw.index(b"\xff\xda") + 2 + 12
        motion_jpeg._entropy(slow, raw, start, [0, 0, 0], {k: motion_jpeg._codes(b"\x01" + bytes(15), b"\x08") for k in (0, 16)}, 1)
        assert all((a == b).all() for a, b in zip(slow.blocks, frames[0].blocks))


def test_shots():
    dark, light = bytes([120]) * 192 * 4, bytes([250]) * 192 * 4
    avi = motion_jpeg.read_avi(motion_jpeg.write_avi(dark * 5 + light * 7 + dark * 3, 4))
    frames = [motion_jpeg.decode_frame(f) for f in avi.frames]
    assert motion_jpeg.shots(frames) == [(0, 5), (5, 7), (12, 3)]
    assert motion_jpeg.pixels(frames[0]).shape == (4, 8, 8)


def test_damaged_media(spark):
    good = motion_jpeg.write_avi(bytes(192))
    media = spark.createDataFrame([(1, None), (2, b"RIFF"), (3, good), (4, good[: len(good) // 3])], "doc_id long, media binary")
    found = {r.doc_id: r for r in motion_jpeg.clips(media).collect()}
    assert found[1].error and found[2].error and found[3].n_frames == 1


def brute(texts: dict, k: int, num: int, den: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(jaccard_join.FOLD))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    p, q = sorted((root(i), root(j)))
                    label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_components(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op6_jaccard_join"](spark, DATA).collect()}
    assert found == brute(texts, 4, 85, 100)


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_large_group_of_near_copies(spark, monkeypatch, seed):
    """Copies with one to five edits about the threshold, and short texts of a common passage: long postings and pivots."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(100)] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(words)
    for i in range(120, 170):
        texts[i] = " ".join(f"p{j}" for j in range(20)) + " " + " ".join(f"q{rng.randrange(30)}" for _ in range(rng.randint(0, 6)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for cold, far, carried in ((4, 5_000, 256), (2, 30, 4)):
        monkeypatch.setattr(jaccard_join, "COLD", cold)
        monkeypatch.setattr(jaccard_join, "LONG", far)
        monkeypatch.setattr(jaccard_join, "CARRIED", carried)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(rows, 5, 80, 100).collect()}
        assert found == brute(texts, 5, 80, 100)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    found = {r.v: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[300] == 100 == found[200]


def test_language_accuracy(spark, documents):
    found = queries.QUERIES["op8_language_id"](spark, DATA).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) > 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)


def plain_label(model: language_id.LanguageModel, text: str | None) -> tuple[str, float]:
    """A text's label and score, word by word."""
    found = [p for p in map(model.posterior, WORD.findall(text or "")) if p is not None]
    if not found:
        return "und", 0.0
    total = np.mean(found, axis=0) * min(len(found), language_id.EVIDENCE)
    return model.languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def test_language_of_each_text(spark, documents, texts):
    """The query against a count of all words and n-grams in Python, and a sum of log posteriors by word."""
    import zlib

    import pandas as pd

    counts: dict = defaultdict(Counter)
    for r in documents.collect():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            for raw in WORD.findall(r.text or ""):
                if any(map(str.isalpha, raw)) and (word := language_id.normal(raw)):
                    counts[0, r.lang][word] += 1
                    for size in range(1, 6):
                        counts[size, r.lang].update(f"^{word}$"[i : i + size] for i in range(len(word) + 3 - size))
    rows = []
    for (size, lang), items in counts.items():
        best = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[: language_id.KEPT_GRAMS if size else language_id.KEPT_WORDS]
        rows += [(lang, item, n, size) for item, n in best]
    frame = pd.DataFrame(rows, columns=["lang", "item", "n", "size"])
    model = language_id.fitted(frame[frame["size"] == 0], frame[frame["size"] > 0])
    for r in queries.QUERIES["op8_language_id"](spark, DATA).collect():
        label, score = plain_label(model, texts[r.doc_id])
        assert r.lang_pred == label and abs(r.score - score) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_backoff():
    import pandas as pd

    columns = ["lang", "item", "n", "size"]
    words = pd.DataFrame([("a", "hund", 9, 0), ("b", "maus", 4, 0)], columns=columns)
    grams = pd.DataFrame([("a", "und", 4, 3), ("b", "und", 1, 3), ("a", "at$", 1, 3), ("b", "at$", 9, 3)], columns=columns)
    model = language_id.fitted(words, grams)
    assert model.posterior("Hund,").argmax() == 0 and model.posterior("cat").argmax() == 1 and model.posterior("123") is None and np.allclose(np.exp(model.posterior("zz")), 0.5)
    like = np.array([(9 + 0.5) / (9 + 1), 0.5 / (4 + 1)])
    assert np.allclose(np.exp(model.posterior("hund")), like / like.sum(), atol=1e-6)
    like = np.array([(1 + 0.5) / (5 + 1), (9 + 0.5) / (10 + 1)])
    assert np.allclose(np.exp(model.posterior("kat")), like / like.sum(), atol=1e-6)


def test_co_training_on_held_out_labels(spark):
    """On labels that it has not seen the classifier catches bad documents and leaves good ones, beyond what keeping all would score."""
    path = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    kept, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    found = co_training.score(documents, co_training.train(documents, kept)).join(held, "doc_id").collect()
    bad, good = [r for r in found if r.quality == 0], [r for r in found if r.quality == 1]
    assert len(bad) > 10 and sum(not r.quality_kept for r in bad) >= 0.7 * len(bad) and sum(r.quality_kept for r in good) >= 0.98 * len(good)
    assert sum(r.quality_kept == bool(r.quality) for r in found) > len(good) + 0.5 * len(bad)


def test_sure_rows_are_of_all_documents(spark, documents):
    """A round takes the first sure rows by key of the whole unlabelled table, as scored here one by one."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = co_training.train(documents, labels, rounds=0)
    found = co_training.views(documents)
    rows = found.collect()
    odds = co_training._odds(model, *([r[c] for r in rows] for c in ("columns", "counts")), np.array([r.n_words for r in rows]), *([r[c] for r in rows] for c in ("statistics", "page")))
    scores, labelled = model.scores(*odds), {r.doc_id for r in labels.where("quality is not null").collect()}
    wanted = {(0, 1): 7, (0, 0): 5, (1, 1): 3}
    given = co_training.sure_rows(found, model, labels.where("quality is not null"), wanted, {0: {rows[0].key}, 1: set()})
    for (view, label), most in wanted.items():
        sure = sorted(r.key for r, p in zip(rows, scores[view]) if (p if label else 1 - p) >= co_training.SURE and r.n_words and r.doc_id not in labelled and (view or r.key != rows[0].key))
        assert set(given[(given["view"] == view) & (given["y"] == label)]["key"]) <= set(sure) and len(given[(given["view"] == view) & (given["y"] == label)]) == min(most, len(sure))


def test_quality_scores_of_each_text(spark, documents):
    """The query against every document scored by itself from its own words."""
    from ledgerloom.llm.quality_rules import FEATURES

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = co_training.train(documents, labels)
    w, b = model.text
    found = {r.doc_id: r for r in queries.QUERIES["op9_co_training"](spark, DATA).collect()}
    stats = {r.doc_id: r for r in quality_rules.statistics(documents).collect()}
    for r in documents.collect():
        words, s = WORD.findall(r.text or ""), stats[r.doc_id]
        row = [np.log1p(s.n_words), np.log1p(s.n_lines), s.n_words / max(1, s.n_lines), *(s[top] / s[bottom] if s[bottom] else 0.0 for top, bottom in FEATURES.values())]
        text = b + 10 * w[co_training._buckets(pa.array(words, pa.string()))].sum() / max(1, len(words)) + (np.array(row, np.float32) - model.scale[0]) / model.scale[1] @ w[1 << co_training.TEXT_BITS :]
        page = model.page_odds(co_training._page({"lang": [r.lang], "source": [r.source], "n_chars": [r.n_chars]}))[0]
        wanted = model.scores(np.array([text]), np.array([page]))[2][0] if words else 0.0
        assert abs(found[r.doc_id].score - wanted) < 1e-3 and (abs(wanted - co_training.LEAST_SCORE) < 1e-3 or found[r.doc_id].kept == (wanted >= co_training.LEAST_SCORE))


def test_rules_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rules = quality_rules.learn_rules(documents, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0 and quality is not null")
    found = quality_rules.statistics(documents.join(F.broadcast(held.select("doc_id")), "doc_id", "left_semi")).withColumn("kept", quality_rules.verdict(rules)).join(held, "doc_id").collect()
    bad, good = [r for r in found if r.quality == 0], [r for r in found if r.quality == 1]
    assert rules and sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(r.kept for r in good) >= 0.99 * len(good)


def test_media_of_each_text(spark, texts):
    """The query's payloads and files, byte for byte."""
    import hashlib

    for r in queries.QUERIES["op4_motion_jpeg"](spark, DATA).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = motion_jpeg.write_avi(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        units = np.frombuffer(payload, np.uint8).reshape(-1, 192)
        short = -len(units) % min(len(units), motion_jpeg.FRAME_UNITS)
        luma = np.concatenate((units[:, 0], np.full(short, 32, np.uint8))).astype(int)
        luma = np.where(luma >= 128, luma, luma - 255) // 8 + 128
        assert r.feature.startswith(f"frames={-(-len(units) // motion_jpeg.FRAME_UNITS) if len(units) > motion_jpeg.FRAME_UNITS else 1};") and r.feature.endswith(f"luma={int(luma.sum()) // len(luma)}")


def test_pipeline_stages(spark, tmp_path):
    """Each stage's rows from its own input, recomputed independently of the stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        found = out.collect()
        if name == "language":
            model = language_id.train(docs.where(language_id.in_training(F.col("doc_id"))))
            labels = {r.doc_id: plain_label(model, r.text) for r in rows}
            wanted = [i for i, (label, score) in labels.items() if label != "und" and score > corpus_pipeline.LEAST_LANGUAGE_SCORE]
            assert {r.doc_id for r in found} ^ set(wanted) <= {i for i, (_, score) in labels.items() if abs(score - corpus_pipeline.LEAST_LANGUAGE_SCORE) < 1e-3}
        elif name == "quality":
            model = co_training.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = {r.doc_id: r.quality_score for r in co_training.score(docs, model).collect()}
            assert {r.doc_id for r in found} == {i for i, s in scores.items() if s >= co_training.LEAST_SCORE}
        elif name == "near_copies":
            groups = brute({r.doc_id: r.text for r in rows}, 5, 80, 100)
            assert sorted(r.doc_id for r in found) == sorted({component for _, component in groups.values()})
        elif name == "mixing":
            plan = Counter(r.doc_id for r in found)
            sizes = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in rows}
            totals, order = Counter(), sorted({r.source for r in rows})
            for n, s in sizes.values():
                totals[s] += n
            weight, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(totals.values()), {}
            while any(s not in target and weight[s] * left / sum(weight[x] for x in order if x not in target) > 3 * totals[s] for s in order):
                share = left / sum(weight[x] for x in order if x not in target)
                for s in [s for s in order if s not in target and weight[s] * share > 3 * totals[s]]:
                    target[s] = 3 * totals[s]
                left = sum(totals.values()) - sum(target.values())
            share = left / max(1, sum(weight[x] for x in order if x not in target))
            for i, (_, s) in sizes.items():
                rate = target.get(s, weight[s] * share) / totals[s]
                assert int(rate + 1e-9) <= plan[i] <= int(rate) + 1
        else:
            ids = sum(len(tokens.encoder(tokens.public_path("word_bpe_49k.json")).tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
            filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
            assert sum(r.n for r in filled) == ids and sum(r.n != 4096 for r in filled) <= 1
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


def test_mix_comes_near_its_targets(spark):
    found = queries.QUERIES["op10_source_mix"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) < 0.2 * r.target and r.over <= 0


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 40), (300, 310), (1000, 1100), (600, 520)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate((x[: n // 2], rng.integers(0, 2**63, m - n // 2, dtype=np.uint64)))
        bound = jaccard_join._least_difference(jaccard_join._signature(np.unique(x)), jaccard_join._signature(np.unique(y)))
        assert 0 <= bound <= len(np.setxor1d(x, y)) and (n < 300 or bound > 0.4 * len(np.setxor1d(x, y)))
