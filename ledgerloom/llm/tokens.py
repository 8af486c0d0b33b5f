"""Token ids of Arrow text columns by a tokenizers file.

Two kinds of file never let a token cross a gap between words: byte-level BPE
with its own regex (a token may begin with one space), and lower-casing BPE
with word ends (white space is dropped).  For these a text is cut at gaps, each
distinct piece is encoded once and kept, and a text's ids are gathered from its
pieces.  Every other file, and every text in which such a cut could matter, is
encoded whole.  The ids are those of ``Tokenizer.encode`` in all cases.

Pieces stay in Arrow: only those that a worker has not kept reach the tokenizer,
joined into a few long texts, and no Python object is made for a known piece.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ledgerloom.llm.held import held
from ledgerloom.llm.words import split

#: Distinct pieces that a worker keeps; later ones are encoded anew in each slice.
KEPT_PIECES = 500_000
#: Pieces that are encoded as one text.
JOINED = 4_000
#: Text bytes that are encoded at once.
SLICE_BYTES = 8 << 20
#: A space after another white-space character: the cut before it is not safe.
GAP_RUN = r"[\s\x0b\x1c-\x1f\x{85}\pZ] "
#: A final comma or full stop after a Latin letter is a token of its own.
TAIL = r"[A-Za-z\x{AA}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}][,.]$"
#: Pieces that may be joined with others; those with marks, white space or control characters inside go alone.
PLAIN = r"^ ?[!-~\p{L}\p{N}\p{P}\p{S}]+$"


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for ``path``, loaded once."""
    return held(("encoder", path), lambda: PieceEncoder(path))


def _kind(path: str) -> str:
    spec = json.loads(open(path, encoding="utf-8").read())
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and not parts[1]["use_regex"] and parts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        return "word"
    return "whole"


class PieceEncoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.most = _kind(path), kept
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = {"byte": "\n", "word": "\x01"}.get(self.kind, "")
        self.glue = {"byte": "\n", "word": " \x01 "}.get(self.kind, "")
        found = self._plain([self.mark])[0] if self.mark else []
        if len(found) != 1:
            self.kind = "whole"
        self.mark_id = found[0] if found else -1
        self.keys = pa.array([",", "."])  # the tails are always kept, first
        self.ends, self.pool = self._one_by_one([",", "."])

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self._plain(texts), self.dtype)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, of ``dtype``."""
        n = len(text)
        if self.kind == "whole":
            return self._one_by_one(text.to_pylist())
        odd = np.zeros(n, bool)
        for token in self.special:
            odd |= _mask(pc.match_substring(text, token))
        if self.kind == "byte":
            odd |= _mask(pc.match_substring_regex(text, GAP_RUN))
        if not odd.any():
            return self._gathered(text)
        lists: list = [None] * n
        rest, whole = np.flatnonzero(~odd), np.flatnonzero(odd)
        if len(rest):
            offsets, ids = self._gathered(text.take(pa.array(rest)))
            for k, i in enumerate(rest):
                lists[i] = ids[offsets[k] : offsets[k + 1]]
        for i, found in zip(whole, self._plain([text[int(i)].as_py() for i in whole])):
            lists[i] = np.array(found, self.dtype)
        return np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.concatenate(lists)

    def _pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Each text's place among the pieces, the pieces' codes, and the distinct pieces."""
        if self.kind == "word":
            offsets, flat = split(text)
            return offsets, *_coded(flat)
        lists = pc.split_pattern(text, " ")
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        codes, bare = _coded(flat)
        first_codes, first = _coded(flat.take(pa.array(offsets[:-1])))
        codes = codes.copy()
        codes[offsets[:-1]] = first_codes + len(bare)  # a text's first piece has no space before it
        return offsets, codes, pa.concat_arrays([pc.binary_join_element_wise(" ", bare, ""), first])

    def _gathered(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, codes, pieces = self._pieces(text)
        tailed = pc.match_substring_regex(pieces, TAIL)
        tail = np.where(_mask(tailed), np.where(_mask(pc.ends_with(pieces, ",")), 0, 1), -1)[codes]
        bases = pc.if_else(tailed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        if self.kind == "word":
            bases = pc.if_else(pc.string_is_ascii(bases), pc.ascii_lower(bases), bases)
        key_codes, keys = _coded(bases)
        slots, ends, pool = self._lookup(keys)
        more = tail >= 0
        before = np.concatenate(([0], np.cumsum(more)))  # tails before each piece
        sequence = np.empty(len(codes) + before[-1], np.int32)
        at = np.arange(len(codes)) + before[:-1]
        sequence[at] = slots[key_codes[codes]]
        sequence[at[more] + 1] = tail[more]
        starts, sizes = ends[:-1][sequence], np.diff(ends)[sequence]
        stops = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        place = np.repeat((starts - stops[:-1]).astype(np.int32), sizes)
        place += np.arange(stops[-1], dtype=np.int32)
        return stops[offsets + before[offsets]], pool[place]

    def _lookup(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key's slot, and ends and ids of all slots; new keys are kept while there is room."""
        slots = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        missing = np.flatnonzero(slots < 0)
        if not len(missing):
            return slots, self.ends, self.pool
        wanted, had = keys.take(pa.array(missing)), len(self.keys)
        new_ends, ids = self._encoded(wanted)
        ends, pool = np.concatenate((self.ends, self.ends[-1] + new_ends[1:])), np.concatenate((self.pool, ids))
        slots[missing] = np.arange(had, had + len(missing), dtype=np.int32)
        room = max(0, min(len(missing), self.most - had))
        if room:
            self.keys = pa.concat_arrays([self.keys, wanted[:room]])
            self.ends = ends[: had + room + 1].copy()
            self.pool = pool[: self.ends[-1]].copy()
        return slots, ends, pool

    def _encoded(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ends and ids of each piece; plain ones are encoded as long texts and cut at the marks."""
        plain = _mask(pc.match_substring_regex(wanted, PLAIN))
        sizes, parts = np.zeros(len(wanted), np.int64), []
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n = int(plain.sum())
        joined = wanted.take(pa.array(order[:n]))
        for k in range(0, n, JOINED):
            group = joined[k : k + JOINED]
            ends, ids = self._joined(group)
            sizes[k : k + len(group)] = np.diff(ends)
            parts.append(ids)
        if n < len(wanted):
            ends, ids = self._one_by_one(wanted.take(pa.array(order[n:])).to_pylist())
            sizes[n:] = np.diff(ends)
            parts.append(ids)
        return _reordered(np.concatenate(([0], np.cumsum(sizes))), np.concatenate(parts), np.argsort(order))

    def _joined(self, group: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group), self.glue)[0].as_py()
        ids = np.array(self._plain([text])[0], self.dtype)
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) != len(group) - 1:
            return self._one_by_one(group.to_pylist())
        ends = np.concatenate(([0], cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]))
        return ends, np.delete(ids, cuts)


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _reordered(ends: np.ndarray, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends)[order]
    stops = np.concatenate(([0], np.cumsum(sizes)))
    return stops, ids[np.repeat(ends[:-1][order] - stops[:-1], sizes) + np.arange(stops[-1])]


def _flat(lists: list[list[int]], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))))
    return ends, np.fromiter(chain.from_iterable(lists), dtype, int(ends[-1]))


def with_end(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids with ``end_id`` after each text."""
    n = len(offsets) - 1
    stops = offsets[1:] + np.arange(n)
    out = np.empty(len(ids) + n, ids.dtype)
    own = np.ones(len(out), bool)
    own[stops] = False
    out[own], out[stops] = ids, end_id
    return offsets + np.arange(n + 1), out


def binary_rows(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The little-endian bytes of ``ids`` from each offset to the next, as an Arrow binary array."""
    ids = np.ascontiguousarray(ids, ids.dtype.newbyteorder("<"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])


def public_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
