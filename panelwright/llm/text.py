"""Text columns as flat byte arrays: words, hashes and windows of a whole batch at once.

A batch of texts is one ``uint8`` array with offsets, taken from the Arrow
buffers without making Python strings.  Words are runs of bytes of a class; a
word never crosses a text.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one round of array work takes at least; a longer text is one round.
BLOCK_BYTES = 2 << 20
#: The same where nothing is gathered over a block.
PIECE_BYTES = 1 << 18


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true inside the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Word bytes where words are runs without white space (space and the five controls 09 to 0D).
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Word bytes where words are runs of ASCII letters, digits and whatever is not ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under the names doc_id and text, whatever else the frame holds."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Rows that travel to a worker at once, where the session does not say otherwise.
_BATCH_SETTING, _SPARK_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session sends texts to workers in smaller batches unless it has a size of its own.

    Texts take kilobytes each, and Spark's default number of rows is held
    several times over: by the executor, by the worker, and on the way back.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _SPARK_BATCH:
        conf.set(_BATCH_SETTING, BATCH_ROWS)
    return df


def map_texts(
    df: DataFrame,
    text_col: str,
    fn: Callable[[pa.Array], dict[str, object] | tuple[np.ndarray, dict[str, object]]],
    schema: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed from a text column, a block of rows at a time, without a shuffle.

    ``fn`` gets the texts of a block and returns the new columns by name, or a
    row selection (indices) with the new columns of the selected rows.  Input
    columns that have the name of a new column are replaced.  ``keep`` names the
    input columns to keep (default: all).
    """
    added = T._parse_datatype_string(schema)
    names = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    source = small_batches(df).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])])
    out = T.StructType([source.schema[c] for c in names] + added.fields)
    kinds = {f.name: f.dataType for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in released(batches):
            for block in blocks(batch, text_col, PIECE_BYTES):
                got = fn(block.column(text_col))
                rows, new = got if isinstance(got, tuple) else (None, got)
                old = block.select(names)
                if rows is not None:
                    old = old.take(pa.array(rows, pa.int64()))
                cols = [old.column(c) for c in names]
                cols += [new[c] if isinstance(new[c], pa.Array) else pa.array(new[c], to_arrow_type(kinds[c])) for c in added.names]
                if len(cols[-1]):
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, *added.names])

    return source.mapInArrow(run, out)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker gives the memory that it has freed back to its machine."""
    yield from batches
    release()


def release() -> None:
    """Gives what a worker has freed back to its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batch: pa.RecordBatch, text_col: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of about ``size`` bytes of text; every row stays whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of the texts (one more than there are texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[0] == off[-1]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a block: byte ranges [start, end) and, per text, the range of its words [at[d], at[d+1])."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.per_text)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Runs of bytes of the class ``inside``; ``cuts`` are further positions no word crosses."""
    n = len(data)
    is_word = inside[data]
    first, last = is_word.copy(), is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        if cuts is not None:
            edge = np.concatenate([edge, cuts])
        first[edge] = is_word[edge]
        last[edge - 1] = is_word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Ranges above this many bytes leave the rounds of eight bytes, which all ranges share.
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand; never 0.

    All ranges take their next eight bytes in one round; nothing is held per byte
    of the block but one padded copy.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))

    def stirred(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return mix(h ^ ((eight[at] & _FIRST_BYTES[np.minimum(left, 8)]) * _SPREAD))

    length = end - start
    h = stirred(length.astype(np.uint64) * _BASE, start, length)
    open_, done = np.flatnonzero(length > 8), 8
    while len(open_) and done < _LONG:
        h[open_] = stirred(h[open_], start[open_] + done, length[open_] - done)
        done += 8
        open_ = open_[length[open_] > done]
    for i in open_.tolist():
        rest = hashlib.blake2b(data[start[i] + done : end[i]], digest_size=8).digest()
        h[i] = mix(h[i : i + 1] ^ np.frombuffer(rest, "<u8"))[0]
    return np.maximum(h, np.uint64(1))


def word_hashes(w: Words) -> np.ndarray:
    return range_hashes(w.data, w.start, w.end)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """Order-aware hash of several hash arrays, element by element; never 0."""
    total = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        total = mix(total * _BASE + h)
    return np.maximum(total, np.uint64(1))


def window_hashes(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside texts, and the position of each window's first word."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(of[: n - size + 1] == of[size - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total = mix(total * _BASE + h[first + k])
    return np.maximum(total, np.uint64(1)), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of a long text, cut where white space follows something else.

    No pre-token and no special token crosses such a place, so the pieces can be
    scanned on their own.  A text without such a place stays one piece.
    """
    begin, n = 0, len(text)
    while n - begin > size:
        at = begin + size
        while at < n and not (text[at].isspace() and not text[at - 1].isspace()):
            at += 1
        yield text[begin:at]
        begin = at
    if begin < n:
        yield text[begin:]
