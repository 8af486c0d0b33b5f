"""Word-first language identification with character back-off (operator 8).

A word known from training gives its log frequency in each language.  An unseen
word backs off to its character n-grams, longest first, and the first length
with a known n-gram decides.  Word scores are log posteriors, so no rare word
outweighs a text; the label is the language with the greatest mean score.

With add-half counts an item's log posterior is log(count + 1/2) less a term of
the language and one of the item, so the model keeps an entry only where an
item was counted in a language: its size follows the words and n-grams that it
keeps, not their number times the languages'.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.held import held
from ledgerloom.llm.words import GOLDEN, code_points, mix64, word_slices
from ledgerloom.storage import materialize

UNDETERMINED = "und"
#: Training documents a language, drawn by the hash of their ids, that the model is fitted on at most (about; the draw is by probability).
SAMPLE_DOCUMENTS = 4_000
#: Words, and n-grams of each length, a language that the model keeps (the most frequent).
KEPT_WORDS, KEPT_GRAMS = 30_000, 8_000
#: Words of all languages together; with many languages each keeps fewer words and n-grams, one of each at least.
ALL_WORDS = 1_000_000
LONGEST_GRAM = 5
#: Words of evidence at most; more text makes a score no surer.
EVIDENCE = 30
#: Scores (documents times languages) that are summed at once.
TABLE = 2_000_000
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„’‘¿¡…–—"


@dataclass
class Items:
    """Words, or n-grams of any length: where each one's entries lie, its kind (0: word, else the length) and its own term."""

    names: list[str]
    ends: np.ndarray  # item i has entries ends[i] to ends[i + 1]
    langs: np.ndarray
    gains: np.ndarray  # log(count + 1/2) - log(1/2)
    own: np.ndarray  # log of the sum of (count + 1/2) / size over the languages

    @staticmethod
    def fit(found, languages: list[str], sizes: np.ndarray) -> "Items":
        """From (item, lang, n, size) rows and each language's add-half total by size."""
        found = found.sort_values(["item", "lang"], kind="stable")
        names, first = np.unique(found["item"].to_numpy(object).astype(str), return_index=True) if len(found) else (np.zeros(0, str), np.zeros(0, np.int64))
        at = {lang: j for j, lang in enumerate(languages)}
        langs = found["lang"].map(at).to_numpy(np.int32)
        n, kinds = found["n"].to_numpy(np.float64), found["size"].to_numpy(np.int64)[first]
        ends = np.append(first, len(found)).astype(np.int64)
        item = np.repeat(np.arange(len(names)), np.diff(ends))
        own = np.log((0.5 / sizes).sum(axis=1)[kinds] + np.bincount(item, weights=n / sizes[kinds[item], langs], minlength=len(names)))
        return Items([str(x) for x in names], ends, langs, np.log(2 * n + 1).astype(np.float32), own.astype(np.float32))


@dataclass
class Scored:
    """Words' scores as flat arrays: kind (0: known, 1 to 5: by n-grams of that length, -1: nothing is known, -2: no letter), own term, and entries."""

    kinds: np.ndarray
    own: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    gains: np.ndarray


@dataclass
class LanguageModel:
    key: str
    languages: list[str]
    words: Items
    grams: Items
    rest: np.ndarray  # log(1/2) less the log add-half total, by size and language
    known: pa.Array | None = None
    hashes: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "hashes": None}

    def _indexes(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The known words, and the n-grams' hashes in order with their places; made once a worker."""
        if self.known is None or self.hashes is None:
            self.known = pa.array(self.words.names, pa.string())
            letters, starts = code_points(self.grams.names)
            sizes = np.diff(starts)
            found = np.zeros(len(sizes), np.uint64)
            for size in range(1, LONGEST_GRAM + 1):
                found[sizes == size] = _hashed(letters, starts[:-1][sizes == size], size)
            order = np.argsort(found, kind="stable")
            self.hashes = found[order], order
        return self.known, *self.hashes

    def score(self, words: pa.Array) -> Scored:
        """Each word as written: its own entries where it is known, else the mean of its longest known n-grams'."""
        n = len(words)
        known, keys, order = self._indexes()
        lettered = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
        plain = normals(words)
        at = pc.fill_null(pc.index_in(plain, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds, own = np.where(lettered, -1, -2).astype(np.int8), np.zeros(n, np.float32)
        mine = np.flatnonzero(lettered & (at >= 0))
        kinds[mine], own[mine] = 0, self.words.own[at[mine]]
        picks = [(mine, at[mine], np.ones(len(mine), np.float32), self.words)]
        todo = np.flatnonzero(lettered & (at < 0))
        letters, starts = code_points([f"^{w}$" for w in plain.take(pa.array(todo)).to_pylist()])
        word = np.repeat(np.arange(len(todo)), np.diff(starts))
        left, open_ = starts[1:][word] - np.arange(len(word)), np.ones(len(todo), bool)
        for size in range(LONGEST_GRAM, 0, -1):
            place = np.flatnonzero((left >= size) & open_[word])
            if not len(place) or not len(keys):
                continue
            hashed = _hashed(letters, place, size)
            found = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = keys[found] == hashed
            of, item = word[place[hit]], order[found[hit]]
            times = np.bincount(of, minlength=len(todo))
            some = np.flatnonzero(times)
            kinds[todo[some]], open_[some] = size, False
            own[todo[some]] = (np.bincount(of, weights=self.grams.own[item], minlength=len(todo))[some] / times[some]).astype(np.float32)
            picks.append((todo[of], item, (1 / times[of]).astype(np.float32), self.grams))
        return _gathered(kinds, own, picks)

    def posterior(self, raw: str) -> np.ndarray | None:
        """Log posterior of one word over all languages; None where it has no letter."""
        s = self.score(pa.array([raw]))
        if s.kinds[0] == -2:
            return None
        return self.rest[s.kinds[0]] - s.own[0] + np.bincount(s.langs, weights=s.gains, minlength=len(self.languages))


def _hashed(letters: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams of this size at these places."""
    out = np.full(len(starts), size, np.uint64)
    for j in range(size):
        out = mix64(out * GOLDEN + letters[starts + j])
    return out


def _gathered(kinds: np.ndarray, own: np.ndarray, picks: list[tuple[np.ndarray, np.ndarray, np.ndarray, Items]]) -> Scored:
    """Entries of (word, item, weight) picks by word; a word's picks are of one list, in order."""
    sizes = np.zeros(len(kinds), np.int64)
    for word, item, _, items in picks:
        sizes += np.bincount(word, weights=np.diff(items.ends)[item], minlength=len(kinds)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    langs, gains = np.zeros(ends[-1], np.int32), np.zeros(ends[-1], np.float32)
    for word, item, weight, items in picks:
        n = np.diff(items.ends)[item]
        stops = np.cumsum(n)
        inside = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - n, n)  # entry within its item
        before = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        first = np.zeros(len(kinds), np.int64)
        first[word[::-1]] = before[::-1]  # entries of this list before the word's first pick
        target = np.repeat(ends[word] + before - first[word], n) + inside
        source = np.repeat(items.ends[item], n) + inside
        langs[target], gains[target] = items.langs[source], items.gains[source] * np.repeat(weight, n)
    return Scored(kinds, own, ends, langs, gains)


def normals(words: pa.Array) -> pa.Array:
    """Words without marks at the ends, in lower case."""
    return pc.utf8_lower(pc.utf8_trim(words, EDGES))


def normal(raw: str) -> str:
    return normals(pa.array([raw]))[0].as_py()


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3 is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, count) of the words of each slice, numbers and punctuation left out."""
    for part in word_slices(batches):
        words = pc.if_else(pc.match_substring_regex(part.words, r"\p{L}"), normals(part.words), "").to_pylist()
        documents = np.repeat(np.arange(part.rows.num_rows), part.counts)
        langs = part.rows.column(1).dictionary_encode()
        keys = langs.indices.to_numpy(zero_copy_only=False)[documents].astype(np.int64) * len(words) + part.codes
        unique, counts = np.unique(keys, return_counts=True)
        total: dict[tuple[int, str], int] = defaultdict(int)
        for k, n in zip(unique.tolist(), counts.tolist()):
            if word := words[k % len(words)]:
                total[k // len(words), word] += n
        yield _counted(langs.dictionary.to_pylist(), total)


def _grams(words: DataFrame) -> DataFrame:
    """(lang, item, n, size) of the n-grams of counted words."""
    edged, length = F.concat(F.lit("^"), F.col("item"), F.lit("$")), F.length("item") + 2
    cut = lambda size: F.when(length >= size, F.transform(F.sequence(F.lit(1), length - size + 1), lambda i: F.substring(edged, i, size))).otherwise(F.array().cast("array<string>"))
    found = words.select("lang", "n", F.explode(F.flatten(F.array(*[cut(size) for size in range(1, LONGEST_GRAM + 1)]))).alias("item"))
    return found.groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", F.length("item"))


def _counted(names: list[str], total: dict[tuple[int, str], int]) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays([pa.array([names[k[0]] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "item", "n"])


def train(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows with a non-null lang; every label is a language.

    About ``sample_documents`` a language, drawn by hash, are counted in the
    tasks; the bounded tables of the most frequent words and n-grams come to
    the driver.  No labelled row gives a model without languages, and a label
    without a word in its documents is none of the model's.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    labels = materialize(labelled.groupBy("lang").agg((sample_documents / F.count(F.lit(1))).alias("rate")), "language-labels")
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    drawn = labelled.join(labels, "lang").where(draw < F.col("rate")).select("text", "lang")
    counted = drawn.mapInArrow(_word_counts, "lang string, item string, n long")
    words = materialize(counted.groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-words")
    part = min(1.0, ALL_WORDS / (KEPT_WORDS * max(1, labels.count())))
    found_words = _kept(words.withColumn("size", F.lit(0)), max(1, int(KEPT_WORDS * part)))
    found_grams = _kept(_grams(words), max(1, int(KEPT_GRAMS * part)))
    return fitted(found_words, found_grams)


def _kept(counts: DataFrame, most: int):
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "item", "n", "size").toPandas()


def fitted(words, grams) -> LanguageModel:
    """The model of counted words (size 0) and n-grams, rows of (lang, item, n, size): equal priors, add-half counts by size."""
    languages = sorted(set(words["lang"]))
    sizes = np.ones((LONGEST_GRAM + 1, max(1, len(languages))))
    for found in (words, grams):
        for size in found["size"].unique():
            part = found[found["size"] == size]
            totals = part.groupby("lang")["n"].sum()
            sizes[size] = [totals.get(lang, 0) + 0.5 * part["item"].nunique() for lang in languages]
    rest = np.concatenate((np.log(0.5 / sizes), np.full((1, sizes.shape[1]), -np.log(max(1, len(languages))))))  # the last row is kind -1
    found = Items.fit(words, languages, sizes), Items.fit(grams, languages, sizes)
    key = f"{len(found[0].names)}-{len(found[1].names)}-{float(found[0].own.sum())!r}"
    return LanguageModel(key, languages, *found, rest)


def _kept_model(model: LanguageModel) -> LanguageModel:
    """The worker's copy of the model, with its indexes."""
    return held(("language", model.key), lambda: model)


def identify(documents: DataFrame, model: LanguageModel, added: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``documents`` with lang_pred and lang_score (0 to 1), or ``added`` names; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text under a model without languages.  Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c not in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[F.col(f"`{c}`") for c in kept]).schema.fields)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _kept_model(shared.value)
        for part in word_slices(batches):
            lang, score = _labels(fitted, part)
            yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.rows.schema.names, *added])

    return documents.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(label, f"{schema}, `{added[0]}` string, `{added[1]}` double")


def _labels(model: LanguageModel, part) -> tuple[list[str], np.ndarray]:
    n, width = part.rows.num_rows, len(model.languages)
    if not width:
        return [UNDETERMINED] * n, np.zeros(n)
    scored = model.score(part.words)
    labels, scores = [], []
    step = max(1, TABLE // width)
    for a in range(0, n, step):
        b = min(n, a + step)
        own = part.codes[part.offsets[a] : part.offsets[b]]
        lettered = scored.kinds[own] > -2
        documents, own = np.repeat(np.arange(b - a), part.counts[a:b])[lettered], own[lettered]
        lettered = np.bincount(documents, minlength=b - a)
        kinds = np.bincount(documents * len(model.rest) + scored.kinds[own] % len(model.rest), minlength=(b - a) * len(model.rest)).reshape(b - a, -1)
        total = kinds @ model.rest - np.bincount(documents, weights=scored.own[own], minlength=b - a)[:, None]
        sizes = np.diff(scored.ends)[own]
        stops = np.cumsum(sizes)
        entry = np.repeat(scored.ends[:-1][own] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
        total += np.bincount(np.repeat(documents, sizes) * width + scored.langs[entry], weights=scored.gains[entry], minlength=(b - a) * width).reshape(b - a, width)
        mean = total / np.maximum(lettered, 1)[:, None] * np.minimum(lettered, EVIDENCE)[:, None]
        best = mean.argmax(axis=1)
        score = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
        score[lettered == 0] = 0
        labels += [model.languages[j] if w else UNDETERMINED for j, w in zip(best.tolist(), lettered.tolist())]
        scores.append(score)
    return labels, np.concatenate(scores) if scores else np.zeros(0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents.where(in_training(F.col("doc_id"))))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: A learned model can't be expressed in SQL; tests/llm labels each text again word by word, and measures held-out accuracy.
ORACLE = None
