"""Learned decision lists over text statistics (operator 1).

Sequential covering: a conjunction of thresholds is grown by FOIL gain on one
part of the labelled rows, pruned from its end on the other, and kept while it
is precise; the rows it covers go, and the next rule is learned.  The ordered
rules become one Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.words import GOLDEN, WordSlice, mix64, word_slices

REPEAT_WINDOW = 5
#: Labelled rows that rules are learned from at most, the first by a hash of the id.
SAMPLE_ROWS = 20_000
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 4, 40
#: A rule must be so precise on the rows that pruned it, and cover so many rows.
LEAST_PRECISION, LEAST_COVER = 0.95, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marked_words", "n_top_word"]
STATS = ", ".join(f"{c} long" for c in COUNTS)
FEATURES = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marked_share": ("n_marked_words", "n_words"),
    "top_word_share": ("n_top_word", "n_words"),
}


def _per_document(part: WordSlice, values: np.ndarray) -> np.ndarray:
    """Sums of word-position values by document."""
    ends = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return ends[part.offsets[1:]] - ends[part.offsets[:-1]]


def _repeats(part: WordSlice) -> np.ndarray:
    """Words in 5-word windows found twice or more in their text."""
    n = len(part.codes)
    if n < REPEAT_WINDOW:
        return np.zeros(part.rows.num_rows, np.int64)
    documents = np.repeat(np.arange(part.rows.num_rows, dtype=np.uint64), part.counts)
    value = mix64(np.arange(1, len(part.words) + 1, dtype=np.uint64) * GOLDEN)[part.codes]
    last = n - REPEAT_WINDOW + 1
    key = documents[:last] * GOLDEN
    for j in range(REPEAT_WINDOW):
        key = mix64(key + value[j : last + j] + np.uint64(j))
    key = key[inside := documents[:last] == documents[REPEAT_WINDOW - 1 :]]
    at = np.flatnonzero(inside)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT_WINDOW, -1)
    return _per_document(part, np.cumsum(change[:-1]) > 0)


def _lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one."""
    lists = pc.split_pattern(text, "\n")
    coded = lists.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    documents = np.repeat(np.arange(len(text)), np.diff(lists.offsets.to_numpy()))
    has = worded[codes]
    lines = np.bincount(documents[has], minlength=len(text))
    distinct = np.unique(documents[has] * (len(worded) + 1) + codes[has])
    return lines, lines - np.bincount(distinct // (len(worded) + 1), minlength=len(text))


def _distinct(part: WordSlice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and the count of the most frequent one."""
    n, width = part.rows.num_rows, len(part.words) + 1
    keys, counts = np.unique(np.repeat(np.arange(n, dtype=np.int64), part.counts) * width + part.codes, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, keys // width, counts)
    return np.bincount(keys // width, minlength=n), top


def counts_of(part: WordSlice) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    w = part.words
    of = {
        "word_chars": pc.utf8_length(w),
        "n_symbols": pc.count_substring_regex(w, r"[#*$%&|<>]"),
        "n_upper": pc.count_substring_regex(w, r"\p{Lu}"),
        "n_letters": pc.count_substring_regex(w, r"\pL"),
        "n_digits": pc.count_substring_regex(w, r"\p{Nd}"),
        "n_marked_words": pc.match_substring_regex(w, r"[^\pL\pN]$"),
    }
    found = {k: _per_document(part, v.to_numpy(zero_copy_only=False).astype(np.int32)[part.codes]) for k, v in of.items()}
    found["n_words"], found["n_repeat_words"] = part.counts, _repeats(part)
    found["n_lines"], found["n_dup_lines"] = _lines(part.text)
    found["n_distinct_words"], found["n_top_word"] = _distinct(part)
    return found


def shares_of(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The features of rules and classifiers: each a count over another, 0 where that is 0."""
    return {name: np.where(counts[b] > 0, counts[a] / np.maximum(counts[b], 1), 0.0) for name, (a, b) in FEATURES.items()}


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; null and empty texts have none of anything."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            found = counts_of(part)
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, {STATS}")


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.cut if self.above else values[self.feature] <= self.cut

    def column(self) -> Column:
        return feature(self.feature) > F.lit(self.cut) if self.above else feature(self.feature) <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(values) for c in rule), np.ones(n, bool))


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        best, gained = None, 1e-9
        for name, column in values.items():
            for cut in np.unique(np.quantile(column[inside], np.linspace(0, 1, CUTS + 2)[1:-1])):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    held = inside & c.holds(values)
                    p, n = (bad & held).sum(), held.sum()
                    if p and n < n0 and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > gained:
                        best, gained = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    best: tuple[float, Rule, float, int] = (-1.0, (), 0.0, 0)
    for k in range(len(rule), 0, -1):
        held = _covers(rule[:k], values, len(bad))
        p, n = int((bad & held).sum()), int(held.sum())
        worth = (2 * p - n) / n if n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / n if n else 0.0, n)
    return best[1:]


def learn(features: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows; none where no rule is precise enough."""
    rules: list[Rule] = []
    turn = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (bad & left & ~turn).sum() >= LEAST_COVER:
        grown, kept = left & ~turn, left & turn
        rule = _grow({k: v[grown] for k, v in features.items()}, bad[grown])
        if not rule:
            break
        rule, precision, n = _prune(rule, {k: v[kept] for k, v in features.items()}, bad[kept])
        if not rule or precision < LEAST_PRECISION or n < min(LEAST_COVER, max(1, kept.sum() // 20)):
            break
        rules.append(rule)
        left &= ~_covers(rule, features, len(bad))
    return rules


def learn_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents (quality 0 is bad), the first by a hash of the id.

    Rows without a label are left out; an id labelled twice counts by its lower
    label, and of rows with one id the first by their statistics is learned
    from.  No labels, or labels of one kind, give no rules.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit("rules"), F.col("doc_id")), "doc_id").limit(sample_rows)
    rows = chosen.toPandas()
    if rows.empty:
        return []
    picked = documents.sparkSession.createDataFrame(rows)  # sample_rows rows at most
    found = statistics(documents.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    once = found.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    counts = once.toPandas().merge(rows, on="doc_id").sort_values("doc_id")
    return learn(shares_of({c: counts[c].to_numpy() for c in COUNTS}), counts["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """False where a rule holds, in order, else true."""
    if not rules:
        return F.lit(True)
    first, *rest = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in rules]
    return reduce(lambda chain, rule: chain.when(rule, F.lit(False)), rest, F.when(first, F.lit(False))).otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_rules(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = statistics(documents).withColumn("base_failed", base_failed())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


#: Learned rules can't be expressed in SQL; tests/llm compares the counts with brute force.
ORACLE = None
