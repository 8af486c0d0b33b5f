"""Mixture-controlled packing into fixed windows (operator 2).

Each source is a queue of its documents' token ids, given out in units of a
whole document or of at most ``QUANTUM`` ids of a longer one.  Deficit
round-robin gives every queue credit in proportion to its target and lets it
give a unit while its credit is not negative; what the unit takes beyond the
credit is a deficit that later windows pay off before the queue's next turn.
The units so ordered are one stream, cut into windows that are all full but the
last.  A queue that runs dry leaves its turns to the rest.

A queue with target w has credit for the unit behind its first c ids when the
round has come to c / w.  So the order of turns is that of c / w, which each
unit knows from the ids before it: totals by source and task carry the deficits
across partitions, a range sort of the units' counters (not of their ids) gives
the stream, and sums by task its places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.words import slices
from ledgerloom.storage import materialize

WINDOW = 4096
#: Ids of a turn at most: a document up to this length stays whole but for the ends of windows.
QUANTUM = 1024
END_ID = 2

UNITS = "part long, row_no long, source string, doc_id long, local_start long, start long, n long, doc_tokens long, width int, ids binary"
ORDER = ["late", "turn", "source", "part", "row_no"]
PIECES = "doc_id long, row_part long, row_no long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_units(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """The ids of every document in units of at most ``quantum``, with the ids before each in its source's queue of that partition."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(tokenizer_path), TaskContext.get().partitionId()
        queues: dict[str | None, int] = {}
        number = 0
        for rows, text in slices(batches, limit=tokens.SLICE_BYTES):
            offsets, ids = tokens.with_end(*encoder.encode(text), end_id)
            sizes = np.diff(offsets)
            units = -(-sizes // quantum)
            document = np.repeat(np.arange(len(sizes)), units)
            start = (np.arange(len(document)) - np.repeat(np.cumsum(units) - units, units)) * quantum
            before = _before(rows.column(1).to_pylist(), sizes.tolist(), queues)
            cuts = np.append(offsets[document] + start, offsets[-1])
            of = pa.array(document)
            m = len(document)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part)), pa.array(np.arange(number, number + m)), rows.column(1).take(of), rows.column(0).take(of), pa.array(before[document] + start), pa.array(start), pa.array(np.diff(cuts)), pa.array(sizes[document]), pa.array(np.full(m, ids.itemsize, np.int32)), tokens.binary_rows(cuts, ids)],
                names=["part", "row_no", "source", "doc_id", "local_start", "start", "n", "doc_tokens", "width", "ids"],
            )
            number += m

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return materialize(chosen.mapInArrow(encode, UNITS), "packing-units")


def _before(sources: list[str | None], sizes: list[int], queues: dict[str | None, int]) -> np.ndarray:
    """Ids of the same source before each document; ``queues`` goes on from batch to batch."""
    out = np.empty(len(sizes), np.int64)
    for i, (source, n) in enumerate(zip(sources, sizes)):
        out[i] = queues.get(source, 0)
        queues[source] = int(out[i]) + n
    return out


def _turns(units: DataFrame, weights: Mapping[str | None, float] | None, temper: float) -> DataFrame:
    """part, row_no, n and the order of turns of each unit: ``late`` (no weight), ``turn``, source."""
    spark = units.sparkSession
    sums = materialize(units.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-sums")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("source").agg(F.sum("n").cast("double").alias("total"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow("total", F.lit(float(temper))))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double").withColumnRenamed("source", "_of")
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    totals = totals.withColumnRenamed("source", "_of")
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).join(totals, F.col("source").eqNullSafe(F.col("_of")))
    late = F.coalesce(F.col("weight") <= 0, F.lit(True))
    bases = materialize(bases.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "base", late.alias("late"), F.when(late, F.col("total")).otherwise(F.col("weight")).alias("share")), "packing-bases")
    own = units.select("part", "row_no", "source", "local_start", "n")
    placed = own.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return placed.select("part", "row_no", "source", "n", "late", ((F.col("base") + F.col("local_start")) / F.col("share")).alias("turn"))


def _stream(turns: DataFrame) -> DataFrame:
    """place (ids before it in the stream) of each unit (part, row_no)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = before + np.cumsum(b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, task)), pa.array(ends - b.column(2).to_numpy()), b.column(2)], names=["part", "row_no", "task", "place", "n"])
            before = int(ends[-1]) if len(ends) else before

    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    ordered = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = materialize(ordered.select("part", "row_no", "n").mapInArrow(run, "part long, row_no long, task long, place long, n long"), "packing-stream")
    totals = found.groupBy("task").agg(F.sum("n").alias("n"))  # a row a task
    base = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    bases = materialize(totals.select("task", base.alias("base")), "packing-tasks")
    return found.join(bases, "task").select(F.col("part").alias("_part"), F.col("row_no").alias("_row"), (F.col("base") + F.col("place")).alias("place"))


def padded(n: int, window: int) -> int:
    """The last window's length once padded: the next power of two, at most the window."""
    return min(window, 1 << max(0, n - 1).bit_length())


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, weights: Mapping[str | None, float] | None = None, temper: float = 1.0, with_ids: bool = True, quantum: int = QUANTUM) -> DataFrame:
    """A row per piece of a document: where its ids go, their checksum, and the ids themselves.

    Each id (the end id included) lies in exactly one piece.  Targets are
    ``weights`` by source (sources without one follow the others, in proportion
    to their totals), else each source's total to the power of ``temper``: 1
    keeps the sources' own shares to the end, less favours small sources until
    they run dry.  Null texts count as empty (the end id alone), null ids are
    kept, and a null source is a source of its own.  Repeated rows are packed as
    often as they occur; an empty table gives no pieces; columns other than
    doc_id, source and text are dropped.
    """
    units = token_units(documents, tokenizer_path, end_id, quantum)
    stream = _stream(_turns(units, weights, temper))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, n, start = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("place", "n", "start"))
            first, last = place // window, (place + n - 1) // window
            unit = np.repeat(np.arange(len(n)), last - first + 1)
            w = first[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin, end = np.maximum(place[unit], w * window), np.minimum((place + n)[unit], (w + 1) * window)
            skip = begin - place[unit]
            data, widths = b.column(b.schema.get_field_index("ids")).to_pylist(), b.column(b.schema.get_field_index("width")).to_pylist()
            crc, own = [], []
            wide, at = None, -1
            for u, i, m in zip(unit.tolist(), skip.tolist(), (end - begin).tolist()):
                if u != at:
                    wide, at = memoryview(np.frombuffer(data[u], f"<u{widths[u]}").astype("<u4")).cast("B"), u
                ids = wide[4 * i : 4 * (i + m)]
                crc.append(zlib.crc32(ids))
                if with_ids:
                    own.append(ids.tobytes())
            of = pa.array(unit)
            column = {c: b.column(b.schema.get_field_index(c)).take(of) for c in ("doc_id", "part", "row_no", "doc_tokens")}
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"], column["part"], column["row_no"], pa.array(start[unit] + skip), pa.array(end - begin), pa.array(crc, pa.int64()), column["doc_tokens"], pa.array(w), pa.array(begin - w * window), pa.array(own, pa.binary()) if with_ids else pa.nulls(len(unit), pa.binary())],
                names=["doc_id", "row_part", "row_no", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    placed = units.drop("source", "local_start").join(stream.hint("shuffle_hash"), (F.col("part") == F.col("_part")) & (F.col("row_no") == F.col("_row"))).drop("_part", "_row")
    last = F.lit(padded(total % window or window, window))
    return placed.mapInArrow(cut, PIECES).withColumn("padded_length", F.when(F.col("sequence_id") < total // window, F.lit(window)).otherwise(last).cast("long"))


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: sequence_id and the ids of its pieces in order (a window holds at most its size)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p"), F.first("padded_length").alias("padded_length")).select("sequence_id", "padded_length", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


#: The registered query flattens the mixture: targets are the square roots of the sources' totals.
TEMPER = 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = pack(documents, tokens.public_path("word_bpe_49k.json"), temper=TEMPER, with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "row_part", "row_no")


#: Token ids can't be expressed in SQL; tests/llm compares with a round-robin, unit by unit.
ORACLE = None
