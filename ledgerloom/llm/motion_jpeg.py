"""AVI motion-JPEG columns: bytes as coefficients, and shots as timed clips (operator 4).

A payload lies in the quantised coefficients of baseline JPEG frames, 192 to an
8 x 8 pixel unit of three components.  Byte b is the coefficient b where b is
at least 128, else b - 255: both have eight magnitude bits, equal to b, so with
a one-bit code each byte takes nine bits and numpy packs and unpacks whole
frames.  Restart markers after every unit reset the DC predictors.  The frames
are ordinary baseline JPEG in an ordinary AVI; other files of this kind are
read by the general entropy decoder below.

Shots: each frame's luma histogram (of the one-eighth image, from the DC terms)
is compared with the frame before it; a cut is a difference well above the mean
of those since the last cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.words import slices

UNIT = 192
FRAME_UNITS = 16
FRAMES_A_SECOND = 25
#: A cut: a difference over mean + CUT_SPREAD * deviation of its shot so far, and over CUT_FLOOR.
CUT_SPREAD, CUT_FLOOR, BINS = 3.0, 0.5, 16

# Fixed values of the JPEG format: the order of coefficients in a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(units: int) -> bytes:
    """Everything before a frame's entropy-coded data, for ``units`` 8 x 8 units in a row."""
    table = bytes([1]) + bytes(15) + bytes([8])  # one code, of one bit, for eight magnitude bits
    tables = b"".join(_segment(0xC4, bytes([kind]) + table) for kind in (0x00, 0x10))
    frame = struct.pack(">BHHB", 8, 8, 8 * units, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC0, frame) + tables + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))


def encode_frame(units: np.ndarray) -> bytes:
    """A baseline JPEG whose coefficients are the rows (192 bytes each) of ``units``."""
    n = len(units)
    bits = np.zeros((n, UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units.reshape(-1, 1), axis=1).reshape(n, UNIT, 8)
    coded = np.packbits(bits.reshape(n, -1), axis=1)
    marked = np.empty((n, coded.shape[1] + 2), np.uint8)
    marked[:, :-2], marked[:, -2], marked[:, -1] = coded, 0xFF, 0xD0 + np.arange(n) % 8
    data = np.zeros(marked.shape, bool)
    data[:, :-2] = coded == 0xFF
    flat, stuffed = marked.ravel()[:-2], np.flatnonzero(data.ravel()[:-2])
    return _header(n) + np.insert(flat, stuffed + 1, 0).tobytes() + b"\xff\xd9"


def write_avi(payload: bytes, frame_units: int = FRAME_UNITS, fps: int = FRAMES_A_SECOND) -> bytes:
    """An AVI of motion-JPEG frames holding ``payload`` (a positive multiple of 192 bytes)."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    width = min(frame_units, len(units))
    short = -len(units) % width
    if short:
        units = np.concatenate((units, np.full((short, UNIT), 32, np.uint8)))
    frames = [encode_frame(units[k : k + width]) for k in range(0, len(units), width)]
    movi, index = [], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(struct.pack("<4sI", b"00dc", len(f)) + f + b"\0" * (len(f) % 2))
        at += len(movi[-1])
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, 8 * width, 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, 8 * width, 8)
    picture = struct.pack("<IiiHH4sIiiII", 40, 8 * width, 8, 1, 24, b"MJPG", 8 * width * 8 * 3, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture) + _chunk(b"strd", struct.pack("<Q", len(payload)))))
    body = b"AVI " + headers + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


@dataclass
class Avi:
    fps: float
    frames: list[memoryview]
    payload_bytes: int | None


def read_avi(data: bytes) -> Avi:
    """Parse RIFF; frames by the idx1 index where there is one, else in file order.  Raises ValueError on other input."""
    view = memoryview(data)
    if len(data) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"frames": [], "index": None, "movi": 0, "fps": 25.0, "payload": None}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if bytes(view[body : body + 4]) == b"movi":
                    found["movi"] = body
                walk(body + 4, min(end, body + size))
            elif name == b"avih":
                found["fps"] = 1e6 / max(1, struct.unpack_from("<I", view, body)[0])
            elif name == b"strd" and size == 8:
                found["payload"] = struct.unpack_from("<Q", view, body)[0]
            elif name == b"idx1":
                found["index"] = view[body : body + size]
            elif name[2:] in (b"dc", b"db"):
                found["frames"].append(view[body : body + size])
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", view, 4)[0]))
    frames = found["frames"]
    if found["index"] is not None:
        entries = [struct.unpack_from("<4sIII", found["index"], k) for k in range(0, len(found["index"]) - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        if entries:
            base = found["movi"] if bytes(view[found["movi"] + entries[0][2] :][:4]) == entries[0][0] else 0
            frames = [view[base + at + 8 : base + at + 8 + size] for _, _, at, size in entries]
    return Avi(found["fps"], frames, found["payload"])


@dataclass
class Frame:
    width: int
    height: int
    components: list[tuple[int, int, int]]  # horizontal and vertical factor, quantisation table
    tables: dict[int, np.ndarray]
    blocks: list[np.ndarray]  # of each component: blocks x 64 coefficients, zigzag order

    def luma_eighth(self) -> np.ndarray:
        """The luma of the one-eighth image: each block's mean, 0 to 255."""
        return np.clip(self.blocks[0][:, 0].astype(np.int32) * int(self.tables[self.components[0][2]][0]) // 8 + 128, 0, 255)


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_frame(data: bytes | memoryview) -> Frame:
    """Quantised coefficients of a baseline JPEG frame.  Raises ValueError on what is not one."""
    data = bytes(data)
    at, quant, huff, interval, frame = 2, {}, {}, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no JPEG marker")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            frame = Frame(width, height, [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])], quant, [])
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            picks = [body[2 + 2 * i] for i in range(body[0])]
            if interval == 1 and [c[:2] for c in frame.components] == [(1, 1)] * 3 and all(v == (b"\x01" + bytes(15), b"\x08") for v in huff.values()):
                _fixed(frame, data, at)
            else:
                _entropy(frame, data, at, picks, {k: _codes(*v) for k, v in huff.items()}, interval)
            return frame
    raise ValueError("no scan in the frame")


def _fixed(frame: Frame, data: bytes, at: int) -> None:
    """Nine bits a coefficient and a restart after every unit: undo the stuffing, then reshape."""
    raw = np.frombuffer(data, np.uint8, len(data) - at - 2, at)
    after = np.flatnonzero(raw == 0xFF) + 1
    zero = after[after < len(raw)]
    keep = np.ones(len(raw), bool)
    keep[zero[raw[zero] == 0]] = False
    plain = raw[keep]
    n = frame.width // 8 * (frame.height // 8)
    plain = np.concatenate((plain, np.zeros(n * (UNIT * 9 // 8 + 2) - len(plain), np.uint8))).reshape(n, -1)[:, :-2]
    bits = np.unpackbits(np.ascontiguousarray(plain), axis=1).reshape(n, UNIT, 9)[:, :, 1:]
    value = np.packbits(bits, axis=2)[:, :, 0].astype(np.int16)
    value = np.where(value >= 128, value, value - 255).reshape(n, 3, 64)
    frame.blocks = [value[:, i] for i in range(3)]


def _entropy(frame: Frame, data: bytes, at: int, picks: list[int], codes: dict, interval: int) -> None:
    """General baseline decoding, bit by bit."""
    wide, high = max(c[0] for c in frame.components), max(c[1] for c in frame.components)
    across, down = -(-frame.width // (8 * wide)), -(-frame.height // (8 * high))
    out: list[list] = [[] for _ in frame.components]
    held = filled = 0

    def bit() -> int:
        nonlocal at, held, filled
        if not filled:
            if at >= len(data) or (data[at] == 0xFF and data[at + 1] != 0):
                held = 0xFF  # past the data: ones, as decoders do
            else:
                held = data[at]
                at += 2 if held == 0xFF else 1
            filled = 8
        filled -= 1
        return held >> filled & 1

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad code")

    def signed(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | bit()
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    before = [0] * len(frame.components)
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            filled = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            before = [0] * len(frame.components)
        for i, (h, v, _) in enumerate(frame.components):
            for _ in range(h * v):
                block = np.zeros(64, np.int16)
                before[i] += signed(symbol(codes[picks[i] >> 4]))
                block[0], k = before[i], 1
                while k < 64:
                    s = symbol(codes[0x10 | picks[i] & 15])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = signed(s & 15)
                    k += 1
                out[i].append(block)
    frame.blocks = [np.array(x, np.int16) for x in out]


def pixels(frame: Frame, component: int = 0) -> np.ndarray:
    """Blocks x 8 x 8 samples of one component, by dequantising and the inverse cosine transform."""
    coefficients = np.zeros((len(frame.blocks[component]), 64))
    coefficients[:, ZIGZAG] = frame.blocks[component] * frame.tables[frame.components[component][2]]
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.clip(np.rint(basis.T @ coefficients.reshape(-1, 8, 8) @ basis) + 128, 0, 255).astype(np.uint8)


def payload(avi: Avi, frames: list[Frame]) -> bytes:
    """The bytes that ``write_avi`` stored."""
    value = np.concatenate([np.stack(f.blocks[:3], axis=1).reshape(-1, UNIT) for f in frames])
    data = np.where(value >= 0, value, value + 255).astype(np.uint8).tobytes()
    return data[: avi.payload_bytes]


def shots(frames: list[Frame]) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot by adaptive histogram differences."""
    if not frames:
        return []
    histograms = np.stack([np.bincount(f.luma_eighth() * BINS // 256, minlength=BINS) / max(1, len(f.blocks[0])) for f in frames])
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    starts, n, total, square = [0], 0, 0.0, 0.0
    for i, d in enumerate(change.tolist(), 1):
        if n >= 2:
            mean = total / n
            limit = max(CUT_FLOOR, mean + CUT_SPREAD * max(0.0, square / n - mean * mean) ** 0.5)
        else:
            limit = 2 * CUT_FLOOR
        if d > limit:
            starts.append(i)
            n, total, square = 0, 0.0, 0.0
        else:
            n, total, square = n + 1, total + d, square + d * d
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(frames)])]


def text_media(documents: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as an AVI.

    A null text counts as empty; equal texts give equal media; other columns are dropped.
    """

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            data = text.cast(pa.binary()).to_pylist()
            media = [write_avi(d + b" " * (-len(d) % UNIT or (0 if d else UNIT)), frame_units) for d in data]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row per shot of each AVI in (doc_id, media): clip_no, start_s, end_s, n_frames; error where it can't be read.

    A null or damaged file gives one row with the error and null times.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    avi = read_avi(data or b"")
                    rows = [(doc_id, k, a / avi.fps, (a + n) / avi.fps, n, None) for k, (a, n) in enumerate(shots([decode_frame(f) for f in avi.frames]))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows = [(doc_id, None, None, None, None, str(e))]
                for row in rows:
                    for column, value in zip(out, row):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "clip_no", "start_s", "end_s", "n_frames", "error"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(cut, f"doc_id {kind}, clip_no long, start_s double, end_s double, n_frames long, error string")


def read_back(media: DataFrame) -> DataFrame:
    """Digests of the payload and of the stored file, and the clips in short, for each row of ``text_media``.

    A null or damaged file gives null digests of its payload, and the error as feature.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                try:
                    avi = read_avi(data or b"")
                    frames = [decode_frame(f) for f in avi.frames]
                    own = payload(avi, frames)
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), f"error={e}"))
                    continue
                cut = shots(frames)
                luma = np.concatenate([f.luma_eighth() for f in frames])
                feature = f"frames={len(frames)};clips={','.join(f'{a / avi.fps:.2f}-{(a + n) / avi.fps:.2f}' for a, n in cut)};luma={int(luma.sum()) // len(luma)}"
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_back(text_media(documents)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))


#: Media files can't be expressed in SQL; tests/llm compares each row with the bytes of its text.
ORACLE = None
