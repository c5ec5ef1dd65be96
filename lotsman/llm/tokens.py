"""Byte-pair encoding of whole columns with a public vocabulary (forced-boundary splitting).

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so it is a certain cut.
A batch is cut there with array operations, equal fragments are found by Arrow's dictionary encoding, each
different fragment is encoded once, and the ids are put together again by position.

A cut is taken only where the pre-splitting pattern also gives the same pieces on both sides when they are
read alone: at the start of a character, not after white space (the pattern looks ahead there) and not before
an apostrophe (contractions).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once.
CHUNK = 2 << 20
#: Different fragments kept per worker; beyond that the cache starts anew.
CACHE = 400_000
_state: dict = {}


def default_vocabulary() -> tuple[str, str]:
    """(path of the rank file of byte_bpe_50k, pattern that splits text before merges)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Codec:
    """Encodes UTF-8 buffers; ``ranks`` is the content of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.plain = tiktoken.Encoding("lotsman", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        inside = np.zeros(65536, bool)
        for token in table:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[b[:-1] * 256 + b[1:]] = True
        right = np.arange(65536) % 256
        left = np.arange(65536) // 256
        # A single-byte blank on the left, a continuation byte or an apostrophe on the right: no cut.
        self.cut = ~inside & ((right & 0xC0) != 0x80) & (right != 0x27) & ~np.isin(left, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
        self.cache: dict[bytes, np.ndarray] = {}

    def bounds(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted starts and ends of the fragments of ``b``; every text starts a fragment of its own."""
        if len(b) == 0:
            return np.zeros(1, np.int64)
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        # Blanks of two or three bytes: C2 85, C2 A0, E1 9A 80, E2 80 80-8A / A8 / A9 / AF, E2 81 9F, E3 80 80.
        two = np.flatnonzero((b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))) + 2
        cut[two[two <= len(b)]] = False
        if len(b) > 2:
            x, y, z = b[:-2], b[1:-1], b[2:]
            three = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            three |= ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
            cut[np.flatnonzero(three) + 3] = False
        cut[offsets] = True
        cut[0] = cut[-1] = True
        return np.flatnonzero(cut)

    def piece(self, fragment: bytes) -> np.ndarray:
        ids = self.cache.get(fragment)
        if ids is None:
            ids = np.array(self.plain.encode_ordinary(fragment.decode("utf-8")), np.int32)
            if len(fragment) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[fragment] = ids
        return ids

    def encode(self, texts: pa.Array, flat: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(ids per text, all ids in order) of a string array; a null text has no ids."""
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        base = int(offsets[0])
        size = int(offsets[-1]) - base
        if size == 0:
            return np.zeros(n, np.int64), np.zeros(0, np.int32)
        b = np.frombuffer(data, np.uint8, size, base)
        offsets = offsets - base
        at = self.bounds(b, offsets)
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(b)]).dictionary_encode()
        code = fragments.indices.to_numpy(zero_copy_only=False)
        each = [self.piece(x) for x in fragments.dictionary.to_pylist()]
        size_of = np.fromiter(map(len, each), np.int64, len(each))
        sizes = size_of[code]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(ends[np.searchsorted(at, offsets)])
        if not flat:
            return counts, None
        start_of = np.concatenate([[0], np.cumsum(size_of)[:-1]])
        pool = np.concatenate(each)
        ids = pool[np.repeat(start_of[code] - ends[:-1], sizes) + np.arange(ends[-1])]
        return counts, ids


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    key = (hash(ranks), pattern)
    if key not in _state:
        _state.clear()
        _state[key] = Codec(ranks, pattern)
    return _state[key]


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about ``limit`` bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i - start
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield start, len(sizes) - start


def _vocabulary(spark: SparkSession, vocabulary: str | None, pattern: str | None):
    """The rank file (under 1 MB, fixed) read once by the driver and broadcast; workers need no such file."""
    path, pat = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    path = vocabulary or path
    if not os.path.exists(path):
        raise FileNotFoundError(f"vocabulary file {path}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or pat))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) of each text by the vocabulary, without special tokens.

    The text is taken as stored.  Null and empty texts get an empty list, blank ones the ids of their blanks.
    Repeated rows give repeated results; other columns are not read.  No shuffle.
    """
    spark = df.sparkSession
    shared = _vocabulary(spark, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for batch in batches:
            for start, n in slices(batch.column(1)):
                counts, ids = c.encode(batch.column(1).slice(start, n))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens BIGINT) of each text; 0 for null and empty texts.  No shuffle."""
    spark = df.sparkSession
    shared = _vocabulary(spark, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for batch in batches:
            counts = [c.encode(batch.column(1).slice(s, n), flat=False)[0] for s, n in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decoded(ids: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, text) of encoded texts (id, ids): the way back, which tests and audits take.  Empty lists give ''."""
    shared = _vocabulary(ids.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = codec(*shared.value).plain
        for batch in batches:
            texts = [plain.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, text string")
