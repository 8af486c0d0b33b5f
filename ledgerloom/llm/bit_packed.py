"""Token-id files with fixed-width bit packing (operator 7).

A file holds a run of documents in ascending id order.  Every id takes the
fewest bits that hold the vocabulary (16 for 50,257 ids).  Ids lie in blocks of
``BLOCK`` and the header has each block's byte offset, so a reader seeks to any
id and unpacks whole blocks with numpy.

Layout, little-endian: magic ``LLBP``, u8 width, 3 zero bytes, u32 documents,
u64 ids, u32 block size, u32 blocks; then per document u8 has_id, i64 doc_id;
u64 first id of each document and the end; u64 byte offset of each block in the
payload and the end; the payload.

Files are rows of a Parquet table in the shared folder, so any store that Spark
writes can hold them; ``export`` puts them into a plain folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.words import slices
from ledgerloom.storage import materialize

MAGIC, HEAD = b"LLBP", struct.Struct("<4sB3xIQII")
BLOCK = 4096
#: A file ends with the document that reaches so many ids.
FILE_IDS = 2_000_000
END_ID = 0

FILES = "part long, file_no long, first_id long, n_documents long, n_ids long, data binary"
DOCUMENTS = "part long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first; the last byte is padded with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    payload = [pack_bits(ids[k : k + block], width) for k in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in payload]))).astype("<u8")
    has = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, width, len(doc_ids), len(ids), block, len(payload)), has.tobytes(), keys.tobytes(), starts.tobytes(), offsets.tobytes(), *payload])


class PackedFile:
    """Reader with random access to documents and id ranges."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, n, self.n_ids, self.block, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.view, at = memoryview(data), HEAD.size
        self.has = np.frombuffer(data, np.uint8, n, at).astype(bool)
        at += n
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``, by the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(self.view[self.payload + self.offsets[k] : self.payload + self.offsets[k + 1]], n, self.width))
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, row_no, width and the ids (with ``end_id``) of every text, where it is read."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = width_for(max(encoder.vocabulary, end_id + 1))
        for rows, text in slices(batches, limit=tokens.SLICE_BYTES):
            offsets, ids = tokens.with_end(*encoder.encode(text), end_id)
            n = len(text)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(n, part)), pa.array(np.arange(number, number + n)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, ids.itemsize, np.int32)), tokens.binary_rows(offsets, ids)], names=["doc_id", "part", "row_no", "width", "bytes", "ids"])
            number += n

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(chosen.mapInArrow(encode, "doc_id long, part long, row_no long, width int, bytes int, ids binary"), "token-ids")


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id``, and write files in ascending doc_id order; a row a file.

    Null texts count as empty (the end id alone); null ids come first; rows
    with one id are ordered by a hash of their ids, so equal rows lie together
    and a frequent id is still dealt over many tasks; an empty table gives no
    files; columns other than doc_id and text are dropped.  Files are numbered
    in order by (part, file_no).
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        done, number, first, width = 0, 0, 0, 0

        def file() -> pa.RecordBatch:
            nonlocal number, first, done
            data = write_file(keys, np.array(lengths, np.int64), np.concatenate(parts), width)
            row = pa.record_batch([[part], [number], [first], [len(keys)], [done], [data]], schema=schema)
            number, first, done = number + 1, first + done, 0
            keys.clear(), parts.clear(), lengths.clear()
            return row

        schema = pa.schema([("part", pa.int64()), ("file_no", pa.int64()), ("first_id", pa.int64()), ("n_documents", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for key, bits, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                own, width = np.frombuffer(data, f"<u{size}"), bits
                keys.append(key), parts.append(own), lengths.append(len(own))
                done += len(own)
                if done >= FILE_IDS:
                    yield file()
        if keys:
            yield file()

    ids = encoded(documents, tokenizer_path, end_id).withColumn("at", F.xxhash64("ids"))
    keys = [F.col("doc_id").asc_nulls_first(), "at", "part", "row_no"]
    ordered = ids.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select("doc_id", "width", "bytes", "ids").mapInArrow(pack, FILES), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """A row per document of the files: start (ids before it in the whole sequence), n_tokens, ids_crc32."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f = PackedFile(data)
                ids = f.read(0, f.n_ids).astype("<u4")
                s = f.starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), part)), pa.array(f.doc_ids, mask=~f.has), pa.array(first + s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    found = files.select("part", "first_id", "data").mapInArrow(unpack, DOCUMENTS)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    bases = materialize(totals.select("part", base.alias("base")), "token-bases")
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def export(files: DataFrame, folder: str) -> None:
    """Write the files one by one into a plain folder (small sets; one file at a time passes the driver)."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in files.select("part", "file_no", "data").toLocalIterator():
        Path(folder, f"{row.part:06d}-{row.file_no:06d}.llbp").write_bytes(row.data)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(token_files(documents, tokens.public_path("byte_bpe_50k.json")))


#: Token ids can't be expressed in SQL; tests/llm compares with whole-text encoding.
ORACLE = None
