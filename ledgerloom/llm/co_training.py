"""Quality classifier by co-training (operator 9).

Two logistic models look at two views of a document.  One sees its text: words
(hashed, as written and by shape) and statistics of words, lines and characters.
The other sees stored columns of its page: language, source, length, and the
parts of its url where there is one.  Each round both models are calibrated on a
held-out part of the labels and score every document, and each labels documents
it is sure of for the other; a view that tells nothing about quality is never
sure, so it does the other no harm.  The joint score adds both log odds,
counting the prior once, as for views that are independent given the label.

The views of all documents are computed once and written; a round reads that
table.  What the driver fits on is bounded: ``LABELLED_ROWS`` labelled rows, and
``PSEUDO_ROWS`` rows a round and model, drawn by hash among all sure documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.held import held
from ledgerloom.llm.quality_rules import FEATURES, counts_of, shares_of
from ledgerloom.llm.words import GOLDEN, WordSlice, code_points, mix64, word_slices
from ledgerloom.storage import materialize

#: Labelled rows that the models are fitted on at most, the first by a hash of the id.
LABELLED_ROWS = 6_000
#: Pseudo-labelled rows that a model gives the other in a round at most, the first by hash of all that it is sure of.
PSEUDO_ROWS = 1_000
TEXT_BITS = 14
#: Hash buckets of each page column, and the columns: text ones, and the length.
CATEGORY_BUCKETS = 32
CATEGORIES, LENGTH = ("lang", "source", "url"), "n_chars"
ROUNDS, SURE, SPARE = 3, 0.95, 3
#: Parts by key in which the tasks' first rows are merged, step by step.
MERGED = (1024, 32, 1)
STEPS, RATE, RIDGE = 120, 0.1, 1e-4
#: Documents with at least this score are kept.
LEAST_SCORE = 0.35
STATISTICS = ["log_words", "log_lines", "words_a_line", *FEATURES]


#: A word's shape is its first characters after runs are shortened to two.
SHAPE = 12


def _kinds() -> np.ndarray:
    """For each code point what stands for it in a shape: a, A, 0 or itself."""
    out = np.arange(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.islower():
            out[i] = ord("a")
        elif c.isalpha():
            out[i] = ord("A")
        elif c.isdigit():
            out[i] = ord("0")
    return out


_table: list[np.ndarray] = []


def _buckets(words: pa.Array) -> np.ndarray:
    """Two hash buckets a word: itself, lower-cased, and its shape (letters as A or a, digits as 0)."""
    if not _table:
        _table.append(_kinds())
    out = np.empty((len(words), 2), np.int64)
    letters, starts = code_points(pc.utf8_lower(words).to_pylist())
    out[:, 0] = _hashed(letters, starts, 1)
    letters, starts = code_points(words.to_pylist())
    kinds = _table[0][letters.astype(np.int64)]
    place = np.arange(len(kinds)) - np.repeat(starts[:-1], np.diff(starts))
    run = np.zeros(len(kinds), bool)
    run[2:] = (kinds[2:] == kinds[1:-1]) & (kinds[2:] == kinds[:-2]) & (place[2:] >= 2)
    kept = np.concatenate(([0], np.cumsum(~run)))
    starts = kept[starts]
    kinds, place = kinds[~run], np.arange(kept[-1]) - np.repeat(starts[:-1], np.diff(starts))
    ends = np.concatenate(([0], np.cumsum(np.minimum(np.diff(starts), SHAPE))))
    out[:, 1] = _hashed(kinds[place < SHAPE], ends, 2)
    return out


def _hashed(letters: np.ndarray, starts: np.ndarray, kind: int) -> np.ndarray:
    """A bucket for each run of letters: the sum of its letters' hashes by place."""
    place = np.arange(len(letters)) - np.repeat(starts[:-1], np.diff(starts))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(letters * GOLDEN + place.astype(np.uint64)))))
    return (mix64(total[starts[1:]] - total[starts[:-1]] + np.uint64(kind)) >> np.uint64(64 - TEXT_BITS)).astype(np.int64)


def _statistics(part: WordSlice) -> np.ndarray:
    counts = counts_of(part)
    shares = shares_of(counts)
    return np.stack([np.log1p(counts["n_words"]), np.log1p(counts["n_lines"]), counts["n_words"] / np.maximum(counts["n_lines"], 1), *(shares[f] for f in FEATURES)], axis=1).astype(np.float32)


def _page(columns: dict[str, list]) -> np.ndarray:
    """The page view: hashed categories (of a url its host and depth), and the log length with a mark where it is missing."""
    n = len(next(iter(columns.values()))) if columns else 0
    out = np.zeros((n, CATEGORY_BUCKETS * len(CATEGORIES) + 3), np.float32)
    for j, name in enumerate(CATEGORIES):
        for i, value in enumerate(columns.get(name, ())):
            if name == "url":
                host, _, path = (value or "").partition("://")[2].partition("/")
                out[i, -3], value = path.count("/"), host.lower()
            out[i, j * CATEGORY_BUCKETS + xxhash.xxh64_intdigest(value or "") % CATEGORY_BUCKETS] = 1
    for i, value in enumerate(columns.get(LENGTH, ())):
        out[i, -2], out[i, -1] = (0.0, 1.0) if value is None else (np.log1p(max(0, value)), 0.0)
    return out


def _page_columns(documents: DataFrame) -> dict[str, Column]:
    """The page columns that are there, by name, in their types."""
    return {c: F.col(c).try_cast("long" if c == LENGTH else "string") for c in (*CATEGORIES, LENGTH) if c in documents.columns}


def _page_of(rows: pa.RecordBatch, names: list[str], first: int) -> np.ndarray:
    """The page view from the columns ``first`` and after."""
    if not names:
        return np.zeros((rows.num_rows, CATEGORY_BUCKETS * len(CATEGORIES) + 3), np.float32)
    return _page({c: rows.column(first + j).to_pylist() for j, c in enumerate(names)})


@dataclass
class TextView:
    """Rows of hashed word shares (entries ends[i] to ends[i + 1]) and statistics."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    dense: np.ndarray

    def __post_init__(self) -> None:
        self.rows = np.repeat(np.arange(len(self.dense)), np.diff(self.ends))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.columns], minlength=len(self.dense)) + self.dense @ w[1 << TEXT_BITS :]

    def transposed(self, r: np.ndarray) -> np.ndarray:
        words = np.bincount(self.columns, weights=self.values * r[self.rows], minlength=1 << TEXT_BITS)
        return np.concatenate((words, self.dense.T @ r))


@dataclass
class Dense:
    x: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(view: TextView | Dense, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows, classes weighing the same."""
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, STEPS + 1):
        r = (_sigmoid(view.dot(w) + b) - y) * weight
        g, gb = view.transposed(r) + RIDGE * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= RATE * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= RATE * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift that make sigmoid(slope z + shift) match the labels."""
    scale = max(1e-6, float(np.abs(z).mean()))
    w, b = fit_logistic(Dense(z[:, None] / scale), y, 1)
    return max(1e-3, float(w[0])) / scale, float(b + _prior(y))


def _prior(y: np.ndarray) -> float:
    return float(np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum())))


@dataclass
class CoModel:
    """Weights on standardised views: of text (words, then statistics) and of the page."""

    text: tuple[np.ndarray, float]
    page: tuple[np.ndarray, float]
    scale: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # mean and spread of the statistics and of the page view
    platt: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    prior: float = 0.0

    @property
    def key(self) -> tuple[float, float]:
        return float(np.abs(self.text[0]).sum()), float(np.abs(self.page[0]).sum())

    def word_weights(self, words: pa.Array) -> np.ndarray:
        """Each word's weight in the text model."""
        return self.text[0][_buckets(words)].sum(axis=1)

    def text_odds(self, words: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        """Raw log odds of the text view from the words' mean weight and the statistics."""
        mean, spread, _, _ = self.scale
        return 10 * words + (statistics - mean) / spread @ self.text[0][1 << TEXT_BITS :] + self.text[1]

    def page_odds(self, page: np.ndarray) -> np.ndarray:
        _, _, mean, spread = self.scale
        return (page - mean) / spread @ self.page[0] + self.page[1]

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text, page and joint scores from both views' raw log odds."""
        za, zb = (slope * z + shift for z, (slope, shift) in zip((text, page), self.platt))
        return _sigmoid(za), _sigmoid(zb), _sigmoid(za + zb - self.prior)


VIEWS = "doc_id long, n_words long, columns binary, counts binary, statistics binary, page binary"


def views(documents: DataFrame) -> DataFrame:
    """Both views of every document (VIEWS) and ``key``, a hash of them; a row a row of ``documents``, written once."""
    page = _page_columns(documents)
    names = list(page)

    def view(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            n, width = part.rows.num_rows, 1 << TEXT_BITS
            document = np.repeat(np.arange(n), part.counts)
            buckets = _buckets(part.words)
            keys, counts = np.unique(np.concatenate([document * width + buckets[part.codes, j] for j in range(2)]), return_counts=True)
            ends = np.searchsorted(keys, np.arange(n + 1) * width)
            rows = [pa.array(part.counts)] + [_rows(x, ends) for x in ((keys % width).astype("<u2"), np.minimum(counts, 65535).astype("<u2"))]
            rows += [pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()) for x in (_statistics(part), _page_of(part.rows, names, 2))]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *rows], names=["doc_id", "n_words", "columns", "counts", "statistics", "page"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(f"_{n}") for n, c in page.items()]).mapInArrow(view, VIEWS)
    return materialize(found.withColumn("key", F.xxhash64("doc_id", "columns", "counts", "page")), "quality-views")


def _rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: Iterable[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _text_view(columns, counts, n_words, statistics) -> TextView:
    """From the columns of VIEWS; the values are ten times the words' shares."""
    sizes = np.fromiter((len(c) // 2 for c in columns), np.int64, len(columns))
    share = np.repeat(10 / np.maximum(np.asarray(n_words, np.float64), 1), sizes)
    return TextView(np.concatenate(([0], np.cumsum(sizes))), _joined(columns, "<u2").astype(np.int64), _joined(counts, "<u2") * share, _joined(statistics, "<f4").reshape(len(sizes), -1).astype(np.float64))


def _scale(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the statistics and of the page view."""
    out: list[np.ndarray] = []
    for name in ("statistics", "page"):
        x = _joined(rows[name], "<f4").reshape(len(rows), -1).astype(np.float64)
        out += [x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)]
    return tuple(out)


def _fit(i: int, rows, scale) -> tuple[np.ndarray, float]:
    """The model of view ``i`` on labelled rows (VIEWS and y)."""
    y = rows["y"].to_numpy(np.int64)
    if i == 0:
        view = _text_view(rows["columns"], rows["counts"], rows["n_words"], rows["statistics"])
        view.dense = (view.dense - scale[0]) / scale[1]
        return fit_logistic(view, y, (1 << TEXT_BITS) + len(STATISTICS))
    page = _joined(rows["page"], "<f4").reshape(len(rows), -1)
    return fit_logistic(Dense((page - scale[2]) / scale[3]), y, page.shape[1])


def _odds(model: CoModel, columns, counts, n_words, statistics, page) -> tuple[np.ndarray, np.ndarray]:
    """Raw log odds of both views from the columns of VIEWS."""
    view = _text_view(columns, counts, n_words, statistics)
    words = np.bincount(view.rows, weights=view.values * model.text[0][view.columns], minlength=len(view.dense)) / 10
    return model.text_odds(words, view.dense), model.page_odds(_joined(page, "<f4").reshape(len(view.dense), -1))


def sure_rows(found: DataFrame, model: CoModel, marks: DataFrame, wanted: dict[tuple[int, int], int], seen: dict[int, set[int]]):
    """Rows of VIEWS that the model of ``view`` surely labels ``y``: of all unlabelled documents, the first by key, as many as wanted at most.

    Every document is scored in its task, which passes on the keys of its first
    rows of each kind, ``SPARE`` times as many as wanted, since labelled ones go
    afterwards; the views of the few that are left are read again.  A row that a
    model has given before is not given again.
    """
    shared = found.sparkSession.sparkContext.broadcast((model, wanted, seen))
    names = ["key", *(c.split()[0] for c in VIEWS.split(", "))]

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted, seen = shared.value
        best: dict[tuple[int, int], dict[int, tuple]] = {k: {} for k in wanted}
        for b in batches:
            column = dict(zip(names, b.columns))
            key, n_words = column["key"].to_numpy(), column["n_words"].to_numpy()
            if not len(key):
                continue
            scores = model.scores(*_odds(model, *(column[c].to_pylist() for c in ("columns", "counts")), n_words, *(column[c].to_pylist() for c in ("statistics", "page"))))
            for (view, label), most in wanted.items():
                p = scores[view]
                sure = np.flatnonzero(((p if label else 1 - p) >= SURE) & (n_words > 0))
                mine = best[view, label]
                for i in sure[np.argsort(key[sure], kind="stable")][: SPARE * most].tolist():
                    if int(key[i]) not in seen[view] and int(key[i]) not in mine:
                        mine[int(key[i])] = column["doc_id"][i].as_py()
                for k in sorted(mine)[SPARE * most :]:
                    del mine[k]
        rows = [(view, label, k, doc_id) for (view, label), mine in best.items() for k, doc_id in mine.items()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=["view", "y", "key", "doc_id"])

    picked = found.select(*names).mapInArrow(pick, "view int, y int, key long, doc_id long").join(marks.select("doc_id"), "doc_id", "left_anti")
    for parts in MERGED:  # a tree: no task reads more than a few thousand first rows, however many tasks scored
        first = Window.partitionBy("view", "y", F.pmod("key", F.lit(parts))).orderBy("key", "doc_id")
        picked = picked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(wanted.values()))
    kept = picked.select("view", "y", "key", "_n").toPandas()
    shared.destroy()
    kept = kept.loc[np.array([n <= wanted[v, label] for v, label, n in zip(kept["view"], kept["y"], kept["_n"])], bool)]
    if kept.empty:
        return kept
    keys = found.sparkSession.createDataFrame([(int(k),) for k in sorted(set(kept["key"]))], "key long")  # a few thousand at most
    rows = found.select(*names).join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"]).toPandas()
    return kept.drop(columns="_n").merge(rows, on="key").sort_values(["view", "y", "key"], kind="stable")


def train(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pseudo_rows: int = PSEUDO_ROWS, rounds: int = ROUNDS) -> CoModel | None:
    """Fit on a bounded sample of labelled documents and what both models label for each other among all others.

    Null labels are none; an id labelled twice counts by its lower label; of
    rows with one id the first by key is fitted on.  None where not both labels
    occur among the sampled documents.
    """
    import pandas as pd

    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.lit("co-training"), F.col("doc_id")), "doc_id").limit(labelled_rows)
    if chosen.isEmpty():
        return None
    found = views(documents)
    once = Window.partitionBy("doc_id").orderBy("key")
    known = found.join(F.broadcast(chosen), "doc_id").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").toPandas().sort_values("doc_id", kind="stable")
    if known["y"].nunique() < 2:
        return None
    held_out = np.arange(len(known)) % 4 == 3
    if known["y"][held_out].nunique() < 2 or known["y"][~held_out].nunique() < 2:
        base, tests = known, known  # too few labels to part: fit and calibrate on all of them
    else:
        base, tests = known[~held_out], known[held_out]
    scale = _scale(base)
    training, seen = [base, base], {0: set(), 1: set()}
    share = float(known["y"].mean())
    wanted = {(view, label): max(1, int(pseudo_rows * (share if label else 1 - share))) for view in (0, 1) for label in (0, 1)}
    y = tests["y"].to_numpy(np.int64)
    fits: list = [None, None]
    for turn in range(rounds + 1):
        fits = [f or _fit(i, training[i], scale) for i, f in enumerate(fits)]
        model = CoModel(*fits, scale)
        odds = _odds(model, tests["columns"], tests["counts"], tests["n_words"], tests["statistics"], tests["page"])
        model.platt, model.prior = tuple(fit_platt(z, y) for z in odds), _prior(y)
        if turn == rounds or not pseudo_rows:
            break
        given = sure_rows(found, model, marks, wanted, seen)
        if given.empty:
            break
        for view in (0, 1):
            mine = given[given["view"] == view]
            seen[view] |= set(mine["key"].tolist())
            if len(mine):
                training[1 - view], fits[1 - view] = pd.concat([training[1 - view], mine[list(base.columns)]], ignore_index=True), None
    return model


ADDED = ("text_score", "page_score", "quality_score", "quality_kept")


def score(documents: DataFrame, model: CoModel | None, names_added: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """``documents`` with text_score, page_score, quality_score (0 to 1) and quality_kept, or ``names_added``.

    A text without words scores 0 and is not kept.  Without a model all others
    score 1 and are kept.  Columns of these names are replaced.
    """
    *added, kept = names_added
    own = [c for c in documents.columns if c not in names_added]
    base = documents.select(*[F.col(f"`{c}`") for c in own])
    page = _page_columns(base)
    names = list(page)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        fitted = held(("co-training", model and model.key), lambda: model)
        for part in word_slices(batches):
            n = part.rows.num_rows
            found = (np.ones(n),) * 3
            if fitted is not None:
                each = fitted.word_weights(part.words)
                words = np.bincount(np.repeat(np.arange(n), part.counts), weights=each[part.codes], minlength=n) / np.maximum(part.counts, 1)
                found = fitted.scores(fitted.text_odds(words, _statistics(part)), fitted.page_odds(_page_of(part.rows, names, len(own))))
            some = part.counts > 0
            yield pa.RecordBatch.from_arrays([*part.rows.columns[: len(own)], *(pa.array(np.where(some, x, 0.0)) for x in found)], names=[*own, *added])

    return base.select("*", *[c.alias(f"__page_{n}") for n, c in page.items()]).mapInArrow(apply, schema + "".join(f", `{c}` double" for c in added)).withColumn(kept, F.col(added[-1]) >= LEAST_SCORE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(documents, model)
    return found.select("doc_id", "text_score", "page_score", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


#: A learned model can't be expressed in SQL; tests/llm scores each document again by itself, and measures held-out accuracy.
ORACLE = None
