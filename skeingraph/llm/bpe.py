"""Byte-level BPE encoding and decoding as a reduction over a binary tree of text halves.

Encoding.  A text longer than a leaf is cut in two, both halves are encoded, and the
results are joined by encoding again a window around the cut that grows until nothing
outside it can change:

* Between pieces of the split pattern: no piece holds white space after a character
  that is none, so a place between such two characters is a piece boundary in every
  context.  The window grows on each side to the nearest such place; what lies beyond
  is encoded as it was.
* Inside one piece (a run longer than a leaf without white space): a token sequence is
  the encoding of its bytes exactly if each neighbouring pair encodes to itself.  The
  window grows by tokens until both seams are such pairs.

Decoding cuts the ids in halves and concatenates the bytes up the tree.

Null texts count as empty and encode to no ids.  Rows are independent of each other, so
ties, repeated rows and clashing extra columns have no effect; tables may be empty.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Code points of a leaf of the text tree, ids of a leaf of the decoding tree, bytes of a leaf within one piece.
LEAF_CHARS, LEAF_IDS, LEAF_BYTES = 2048, 4096, 256
_FIRST_WINDOW = 64
_AFTER_WORD = re.compile(r"\S(?=[ \n\t\r])")


class Codec:
    """Encoder and decoder for one rank file, without special tokens."""

    def __init__(self, ranks_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x.strip())}
        self._ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._size = {i: len(b) for b, i in ranks.items()}
        self._piece = regex.compile(pattern)
        self._leaf_chars, self._leaf_bytes = max(2, leaf_chars), max(2, leaf_bytes)
        self._stable = lru_cache(maxsize=1 << 16)(self._pair_stays)

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text or "", 0, len(text or ""))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self._ranks.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self._leaf_chars:
            return self._ranks.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._settled_before(text, low, middle), self._settled_after(text, middle, high)
        self._drop_tail(left, len(text[start:middle].encode()))
        kept = self._head_count(right, len(text[middle:end].encode()))
        window = text[start:end]
        left += self._ranks.encode_ordinary(window) if len(window) <= 2 * self._leaf_chars else self._long_window(window)
        left += right[kept:]
        return left

    def _settled_before(self, text: str, low: int, middle: int) -> int:
        """The last certain piece boundary inside the left half, or its start."""
        width = _FIRST_WINDOW
        while True:
            from_ = max(low, middle - width)
            places = [m.end() for m in _AFTER_WORD.finditer(text, from_, middle)]
            if places:
                return places[-1]
            if from_ == low:
                return low
            width *= 2

    def _settled_after(self, text: str, middle: int, high: int) -> int:
        """The first certain piece boundary inside the right half, or its end."""
        found = _AFTER_WORD.search(text, middle, high)
        return found.end() if found else high

    def _drop_tail(self, ids: list[int], size: int) -> None:
        while size > 0:
            size -= self._size[ids.pop()]

    def _head_count(self, ids: list[int], size: int) -> int:
        count = 0
        while size > 0:
            size -= self._size[ids[count]]
            count += 1
        return count

    def _long_window(self, window: str) -> list[int]:
        ids: list[int] = []
        for piece in self._piece.findall(window):
            ids += self._encode_piece(piece.encode())
        return ids

    def _whole(self, piece: bytes) -> list[int]:
        return self._ranks._encode_single_piece(piece)

    def _encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self._leaf_bytes:
            return self._whole(piece)
        half = len(piece) // 2
        return self._join_piece(self._encode_piece(piece[:half]), self._encode_piece(piece[half:]))

    def _pair_stays(self, a: int, b: int) -> bool:
        return self._whole(self._bytes[a] + self._bytes[b]) == [a, b]

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            held = b"".join(self._bytes[x] for x in left[len(left) - i :]) + b"".join(self._bytes[x] for x in right[:j])
            window = self._whole(held)
            left_open = i < len(left) and not self._stable(left[len(left) - i - 1], window[0])
            right_open = j < len(right) and not self._stable(window[-1], right[j])
            if not left_open and not right_open:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 + left_open), j * (1 + right_open)


def read_ranks(path: str) -> bytes:
    """A rank file, of one line for each token."""
    with open(path, "rb") as file:
        return file.read()


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(ranks: Broadcast, pattern: str) -> Codec:
    """One codec for each rank file in a worker process."""
    key = hashlib.sha256(ranks.value).digest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """The rank file, which only the driver need reach; its size is that of the vocabulary (about 1 MB)."""
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def _id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids`` (if kept), ``ids_sha256``, ``decoded_sha256``.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, and
    ``decoded_sha256`` over the bytes that the ids decode to.  A null id stays null.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    ranks = _shared(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count, lists, digests, decoded = [], [], [], []
                for text in part.column(1):
                    ids = own.encode(text.as_py())
                    count.append(len(ids))
                    if keep_ids:
                        lists.append(ids)
                    digests.append(hashlib.sha256(_id_bytes(ids)).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                columns = [part.column(0), pa.array(count, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def count_tokens(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """``n_tokens`` of every document beside its ``by`` columns; null texts have 0."""
    by = by or []
    schema = T.StructType([docs.schema[c] for c in by] + [T.StructField("n_tokens", T.LongType())])
    ranks = _shared(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            count = [len(own.encode(text.as_py())) for text in batch.column(len(by))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(count, pa.int64())], names=schema.names)

    return docs.select(*by, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text (``binary``: ids need not end at a character) of every list of ids; null lists are empty."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    ranks = _shared(encoded, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            out = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
