"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 6).

Texts with equal shingle sets are one class; one document stands for it.  Each
set is put in a global order, rare shingles first by a count sketch of the
whole corpus.  Two sets that link share at least l of their first
n - ceil(t n) + l shingles; each document takes the l that makes the estimated
postings and verifications cheapest, and a pair is verified once it shares the
smaller of its two l.

A shingle whose postings stay under ``COLD`` pairs its documents directly.  A
task that meets a shingle more often than that among the documents of one slice
already knows it for a longer one: it sends a mark in place of the entries, so a
shingle that a third of all documents share doesn't gather in one task.
Longer postings come from large groups of near copies, where all pairs would be
a square.  There each document is compared with a pivot, the most central
document of the posting, and stands for its difference to it.  Documents within
the threshold of the pivot are in its component and need no further pairs.  A
document beyond it can link only to one that shares part of its difference, so
it is looked up by the rare part of that difference, again with prefix bounds,
in blocks of bounded size.  No pair is dropped: every pair that shares a prefix
shingle is either verified, or known to be connected through the pivot.

Before whole sets move, each candidate pair is weighed by signatures, bucket
counts of the sets, whose difference bounds the sets' difference from below.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.words import GOLDEN, WordSlice, mix64, word_slices
from ledgerloom.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
#: Counters of the sketch; its size does not depend on the data.
SKETCH_BITS, SKETCH_ROWS = 22, 256
#: Postings up to which a shingle pairs its documents directly.
COLD = 32
#: Postings that the sketch knows to be long go to the pivots without meeting in one task.
LONG = 5_000
#: Largest l, and verifications in units of postings read.
MOST_MATCHES, VERIFY_COST = 4, 20
#: Far documents of one difference shingle in a task at once.
BLOCK = 2_048
#: Differences up to this many shingles travel with their postings; longer ones are verified by the whole sets.
CARRIED = 256
#: Ids whose documents a bit filter of FILTER_BITS (16 MB) picks at the scan.
FILTERED_IDS, FILTER_BITS, FILTER_ROWS = 16_000_000, 1 << 27, 256
REMOVED = np.uint64(0xA5A5A5A55A5A5A5A)
BLOCK_BYTES = 8 * ((1 << SKETCH_BITS) // SKETCH_ROWS)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int
    den: int

    @property
    def t(self) -> float:
        return self.num / self.den

    @property
    def slack(self) -> float:
        """Sets link when their difference is at most this times their sizes' sum."""
        return (self.den - self.num) / (self.den + self.num)

    def least_overlap(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def links(self, difference: int, sizes: int) -> bool:
        return difference * (self.den + self.num) <= (self.den - self.num) * sizes


def shingle_sets(part: WordSlice, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; fewer than k words are one shingle, none an empty set."""
    hashed = np.fromiter((xxhash.xxh64_intdigest(w.translate(FOLD)) for w in part.words.to_pylist()), np.uint64, len(part.words))[part.codes]
    n = len(hashed)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    if n >= k:
        rolled += np.uint64(k)
        for j in range(k):
            rolled = mix64(rolled * GOLDEN + hashed[j : n - k + 1 + j])
    out = []
    for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                h = mix64(h * GOLDEN + hashed[j])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _scan(documents: DataFrame, k: int) -> DataFrame:
    """A row per document (doc_id, n, fp) and rows of sketch counters (row, counts), in one pass."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "fp", "row", "counts"]
        for part in word_slices(batches):
            sets = shingle_sets(part, k)
            if sets:
                flat = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                np.add.at(counts, flat.astype(np.int64), 1)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if counts.any():
            blocks = [_packed(x.astype("<i8")) for x in counts.reshape(SKETCH_ROWS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_ROWS, pa.int64()), pa.nulls(SKETCH_ROWS, pa.int64()), pa.nulls(SKETCH_ROWS, pa.binary()), pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(blocks, pa.binary())], names=names)

    return materialize(documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, fp binary, row int, counts binary"), "shingle-scan")


def _packed(counters: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(counters, asbytes=True)


def _counters(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, BLOCK_BYTES), "<i8")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The corpus counters: each task adds the blocks it reads; a few partial sums a block come to the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = _counters(data)
                total[row] = total[row] + block if row in total else block
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], names=["row", "counts"])

    blocks = scanned.where("row is not null").select("row", "counts")
    out = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    for r in blocks.repartition("row").mapInArrow(add, "row int, counts binary").collect():  # SKETCH_ROWS rows
        out[r.row] += _counters(r["counts"])
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _frequency(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _choose(frequency: np.ndarray, n: int, at: Threshold, noise: float) -> tuple[int, int]:
    """(l, prefix length) with the least estimated cost; each candidate takes l postings or more."""
    least = at.least_overlap(n)
    postings = np.cumsum(np.maximum(frequency[: n - least + MOST_MATCHES] - 1 - noise, 0))
    best = (math.inf, 1)
    for l in range(1, min(MOST_MATCHES, least) + 1):  # noqa: E741
        read = float(postings[n - least + l - 1])
        best = min(best, (read + VERIFY_COST * read / l + l * 0.5, l))
    return best[1], n - least + best[1]


def _prefixes(documents: DataFrame, sketch, k: int, at: Threshold, long_posting: int) -> DataFrame:
    """Each document's prefix: ``tokens`` with short postings and ``long_tokens``, and ``info`` (size, centrality, l).

    Shingles that are long in a slice are long tokens there; a row of nothing
    but ``marks`` names them, for the entries of other slices.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = sketch.value
        noise = 2 * float(counters.mean())
        for part in word_slices(batches):
            ids, fps, info, tokens, long_tokens = [], [], [], [], []
            for doc_id, s in zip(part.rows.column(0).to_pylist(), shingle_sets(part, k)):
                if not len(s) or doc_id is None:
                    continue
                f = _frequency(s, counters)
                order = np.lexsort((s, f))
                l, length = _choose(f[order], len(s), at, noise)  # noqa: E741
                centre = int(1024 * np.log2(np.maximum(f - noise, 1)).mean())
                prefix = order[:length]
                far = f[prefix] > long_posting
                ids.append(doc_id), fps.append(_fingerprint(s)), info.append(len(s) << 20 | centre << 4 | l)
                tokens.append(s[prefix[~far]]), long_tokens.append(s[prefix[far]])
            marks = _hot(tokens)
            if len(marks):
                for i, own in enumerate(tokens):
                    hot = np.isin(own, marks, assume_unique=True)
                    tokens[i], long_tokens[i] = own[~hot], np.concatenate((long_tokens[i], own[hot]))
                ids.append(None), fps.append(None), info.append(None), tokens.append(NONE), long_tokens.append(NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(info, pa.int64()), _lists(tokens), _lists(long_tokens), _lists([NONE] * (len(ids) - bool(len(marks))) + [marks] * bool(len(marks)))], names=["x", "fp", "info", "tokens", "long_tokens", "marks"])

    return documents.select("doc_id", "text").mapInArrow(cut, "x long, fp binary, info long, tokens array<long>, long_tokens array<long>, marks array<long>")


NONE = np.zeros(0, np.uint64)


def _hot(tokens: list[np.ndarray]) -> np.ndarray:
    """Shingles of more than COLD of a slice's documents."""
    if len(tokens) <= COLD:
        return NONE
    found, counts = np.unique(np.concatenate(tokens), return_counts=True)
    return found[counts > COLD]


MET = "token long, x long, y long, info long"


def _postings(entries: DataFrame, at: Threshold) -> DataFrame:
    """From (token, x, info): pairs of short postings (y, with l as info), and the entries of long ones (token).

    An entry without x marks its token as long.
    """

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[tuple[int, int]] = []  # entries of the token at hand, up to COLD
        token, hot = None, False

        def close() -> None:
            if hot or len(held) < 2:
                return
            for i, (x, a) in enumerate(held):
                for y, b in held[i + 1 :]:
                    if min(a >> 20, b >> 20) * at.den >= max(a >> 20, b >> 20) * at.num and x != y:
                        rows.append((None, min(x, y), max(x, y), min(a & 15, b & 15)))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["token", "x", "y", "info"])
            rows.clear()
            return out

        for b in batches:
            tokens = b.column(0).to_numpy()
            if not len(tokens):
                continue
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            ends = np.append(starts[1:], len(tokens))
            wanted = (ends - starts > 1) | (starts == 0) | (ends == len(tokens))  # a run may go on in the next batch
            for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                if tokens[s] != token:
                    close()
                    token, hot = int(tokens[s]), False
                    held.clear()
                entries = list(zip(b.column(1).slice(s, e - s).to_pylist(), b.column(2).slice(s, e - s).to_pylist()))
                own = [e for e in entries if e[0] is not None]
                if not hot and len(held) + len(own) > COLD or len(own) < len(entries):
                    hot, own = True, held + own
                if hot:
                    rows.extend((token, x, None, info) for x, info in own)
                    held.clear()
                else:
                    held.extend(own)
                if len(rows) > 20_000:
                    yield batch()
        close()
        if rows:
            yield batch()

    return entries.repartition("token").sortWithinPartitions("token", "x").mapInArrow(meet, MET)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for the hash of each wanted id: tasks set bits in blocks, and the blocks come to the driver."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _filter_bit(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        blocks = bits.reshape(FILTER_ROWS, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pa.Codec("zstd").compress(blocks[i], asbytes=True) for i in some], pa.binary())], names=["row", "bits"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = np.frombuffer(pa.Codec("zstd").decompress(data, FILTER_BITS // FILTER_ROWS // 8), np.uint8)
                total[row] = total[row] | block if row in total else block
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pa.Codec("zstd").compress(v, asbytes=True) for v in total.values()], pa.binary())], names=["row", "bits"])

    out = np.zeros((FILTER_ROWS, FILTER_BITS // FILTER_ROWS // 8), np.uint8)
    for r in wanted.select("v").coalesce(8).mapInArrow(mark, "row int, bits binary").repartition("row").mapInArrow(merge, "row int, bits binary").collect():  # FILTER_ROWS rows
        out[r.row] = np.frombuffer(pa.Codec("zstd").decompress(r.bits, FILTER_BITS // FILTER_ROWS // 8), np.uint8)
    return out.ravel()


def _filter_bit(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _chosen(documents: DataFrame, wanted: DataFrame, make, kind: str) -> DataFrame:
    """(v, made) of ``make(shingle set)`` for the wanted documents (v), and maybe for a few others.

    Up to ``FILTERED_IDS`` ids a bit filter of fixed size picks the documents
    where they are read, so no text is shuffled; beyond, a join picks them.
    """
    k, column = make
    if wanted.count() <= FILTERED_IDS:
        bits = documents.sparkSession.sparkContext.broadcast(_filter(wanted))
        chosen = documents.select("doc_id", "text")
    else:
        bits = None
        chosen = documents.select("doc_id", "text").join(wanted.select(F.col("v").alias("doc_id")), "doc_id", "left_semi")

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(_picked(batches, bits)):
            sets = shingle_sets(part, k)
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array([column(s) for s in sets], pa.binary())], names=["v", "s"])

    found = materialize(chosen.mapInArrow(take, "v long, s binary"), kind, "uncompressed")
    if bits is not None:
        bits.destroy()  # 16 MB of the driver
    return found


def _signature(shingles: np.ndarray) -> bytes:
    """Counts of the set's shingles by hash bucket, about one bucket a shingle, at most 255 each.

    Buckets are the low bits of the hash, so a signature folds to one of half
    the length by adding its halves.
    """
    size = 1 << max(4, (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' difference: the sum of their buckets' differences (none if a bucket is at 255)."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if x.max() == 255 or y.max() == 255:
        return 0
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.abs(x - y).sum())


def _promising(pairs: DataFrame, at: Threshold) -> DataFrame:
    """Pairs (a, b) with their signatures (sa, sb) whose sets may link."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, sb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                sizes = sum(sa) + sum(sb)
                keep.append(at.links(_least_difference(sa, sb), sizes) or 255 in sa or 255 in sb)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return materialize(pairs.mapInArrow(weigh, "a long, b long"), "pairs")


def _picked(batches: Iterable[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if bits is None:
            yield batch
            continue
        at = _filter_bit(batch.column(0).fill_null(0).to_numpy())
        yield batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def _verified(pairs: DataFrame, at: Threshold) -> DataFrame:
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, sb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(at.links(len(x) + len(y) - 2 * shared, len(x) + len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return pairs.mapInArrow(verify, "a long, b long")


DIFFERENCES = "r long, x long, n long, near boolean, seek array<long>, offer array<long>, d binary"


def _differences(pairs: DataFrame, sketch, at: Threshold) -> DataFrame:
    """Each document's difference to its pivot in the global order: shingles added, then (marked) those removed."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, c = sketch.value, at.slack
        for b in batches:
            near, seek, offer, whole, sizes = [], [], [], [], []
            for sa, sb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, r = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                added, gone = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
                d = np.concatenate((added[np.lexsort((added, _frequency(added, counters)))], np.sort(gone ^ REMOVED)))
                close = at.links(len(d), len(x) + len(r))
                least_far = max(1, math.ceil((len(d) - c * (len(x) + len(r))) / (1 + c) - 1e-9))
                least_any = max(1, math.ceil(len(d) * (1 - c) / 2 - 1e-9))
                near.append(close), sizes.append(len(x)), whole.append(d if len(d) <= CARRIED else None)
                seek.append(d[:0] if close else d[: len(d) - least_far + 1])
                offer.append(d[: len(d) - least_any + 1] if len(d) else d)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(sizes, pa.int64()), pa.array(near, pa.bool_()), _lists(seek), _lists(offer), pa.array([None if w is None else w.tobytes() for w in whole], pa.binary())], names=["r", "x", "n", "near", "seek", "offer", "d"])

    return materialize(pairs.mapInArrow(compare, DIFFERENCES), "pivot-differences", "uncompressed")


def _far_links(differences: DataFrame, at: Threshold) -> DataFrame:
    """Pairs (a, b) with a document beyond its pivot's threshold: sure links, and candidates to verify."""
    seekers = differences.where("not near").select("r", F.explode("seek").alias("token"), "x", "n", "d")
    blocks = seekers.groupBy("r", "token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "difference-blocks")
    seekers = seekers.join(blocks, ["r", "token"]).select("r", "token", F.pmod(F.xxhash64("x"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "x", "n", "d")
    offered = differences.select("r", F.explode("offer").alias("token"), "x", "n", "d").join(blocks, ["r", "token"])
    offered = offered.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("r", "token", "block", F.lit(1).alias("role"), "x", "n", "d")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, far = None, []
        joined: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := joined.get(v, v)) != v:
                joined[v] = v = joined.get(p, p)
            return v

        for b in batches:
            out: list[tuple[int, int, bool]] = []
            for r, token, block, role, x, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if (r, token, block) != key:
                    key, far, joined = (r, token, block), [], {}
                own = None if data is None else frozenset(np.frombuffer(data, np.int64).tolist())
                if role == 0:
                    far.append((x, n, own))
                    continue
                for y, m, other in far:
                    if y == x or min(n, m) * at.den < max(n, m) * at.num or root(x) == root(y):
                        continue
                    if own is None or other is None:
                        out.append((x, y, False))
                    elif at.links(len(own) + len(other) - 2 * len(own & other), n + m):
                        out.append((x, y, True))
                        joined[root(x)] = root(y)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64()), pa.array([p[2] for p in out], pa.bool_())], names=["a", "b", "sure"])

    both = seekers.unionByName(offered).repartition("r", "token", "block").sortWithinPartitions("r", "token", "block", "role")
    return materialize(both.mapInArrow(probe, "a long, b long, sure boolean").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct(), "far-pairs")


def similar(documents: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents`` (doc_id, text).

    Documents link at a Jaccard similarity of num / den or more between their
    distinct ``words``-word shingles (A-Z lower-cased).  A component's id is
    its least doc_id.  Without words or text a document has no shingles and is
    alone.  Rows with one id count as one document; a null id stays alone with
    a null component; an empty table gives an empty one.
    """
    at = Threshold(num, den)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = _scan(documents, words)
    rows = scanned.where("row is null").select("doc_id", "n", "fp")
    sketch = documents.sparkSession.sparkContext.broadcast(_sketch(scanned))
    long_posting = max(LONG, int(8 * sketch.value.mean()))

    classes = materialize(rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    prefixes = _prefixes(documents, sketch, words, at, long_posting).join(classes.select(F.col("fp").alias("_fp"), "rep"), (F.col("x") == F.col("rep")) & (F.col("fp") == F.col("_fp")), "left")
    prefixes = materialize(prefixes.where("rep is not null or x is null").select("x", "info", "tokens", "long_tokens", "marks"), "prefixes", "uncompressed")
    marks = prefixes.where("x is null").select(F.explode("marks").alias("token"), "x", "info").distinct()
    met = materialize(_postings(prefixes.select(F.explode("tokens").alias("token"), "x", "info").union(marks), at), "postings")

    pairs = met.where("token is null").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min("info").alias("l")).where("shared >= l").select("a", "b")
    hot = met.where("token is not null").select("token", "x", "info").union(prefixes.where("size(long_tokens) > 0").select(F.explode("long_tokens"), "x", "info"))
    centre = F.shiftright("info", 4).bitwiseAND(F.lit(0xFFFF))
    pivots = materialize(hot.groupBy("token").agg(F.min_by("x", F.struct(-centre, "x")).alias("r")), "pivots")
    to_pivot = materialize(hot.select("token", "x").join(pivots, "token").where("x <> r").select(F.col("x").alias("a"), F.col("r").alias("b")).distinct(), "to-pivot")
    pairs = materialize(pairs, "pairs")

    signatures = _chosen(documents, materialize(_ends(pairs), "wanted"), (words, _signature), "signatures")
    pairs = _promising(_with_sets(pairs, signatures), at)

    sets = _chosen(documents, materialize(_ends(to_pivot), "wanted"), (words, np.ndarray.tobytes), "shingle-sets")
    differences = _differences(_with_sets(to_pivot, sets), sketch, at)
    sketch.destroy()
    far = _far_links(differences, at)
    unsure = materialize(far.where("not sure").select("a", "b").union(pairs).distinct(), "pairs")
    sets = _chosen(documents, materialize(_ends(unsure), "wanted"), (words, np.ndarray.tobytes), "shingle-sets")
    links = _verified(_with_sets(unsure, sets), at).union(differences.where("near").select("x", "r")).union(far.where("sure").select("a", "b"))
    found = components(links)

    labelled = classes.join(found, F.col("rep") == F.col("v"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    labelled = materialize(labelled, "classes")
    return rows.join(labelled, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Components of a similarity graph can't be expressed in SQL at this size; tests/llm compares with brute force.
ORACLE = None
