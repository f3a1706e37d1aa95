"""Small helpers shared by the operators: tables, batches and vectorised hashing of words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.session import materialize as stored  # noqa: F401  (used by the operators)

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


#: Bytes of a table that every task may hold for a join; a larger one is joined by a shuffle of both sides.
TOLD = 32 << 20


def told_if_small(df: DataFrame, size: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``size`` in bytes, which the caller has measured, is small."""
    return F.broadcast(df) if size <= TOLD else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows, ``each`` at most in one, but no fewer than the session's own count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each), 1)


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that no other column can clash with."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def chunks_of(batches, bytes_each: int, column: int = 1):
    """Arrow batches cut by the size of their text column, so that work arrays stay bounded.

    A single longer text is a chunk of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        sizes = np.diff(np.frombuffer(text.cast(pa.large_string()).buffers()[1], np.int64, batch.num_rows + 1 + text.offset)[text.offset:])
        part = (np.cumsum(sizes) - sizes) // bytes_each
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse modulo 2^64) to the powers 0 to n - 1; kept between calls up to 16 million."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 1 << 24:
            _POWERS[inverse] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of (value + 1) * BASE^place: the hash of a slice is the difference of two."""
    sums = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(len(values))
    np.cumsum(terms, out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices; equal slices have equal hashes wherever they stand."""
    shift = powers(len(sums), inverse=True)[starts]
    return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each begins (one more entry at the end). Null: empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset:]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def words_of(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (one more entry at the end).

    breaks: for each byte, whether it ends a word.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~breaks[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cuts = at[(at > 0) & (at < len(data))]
    begin[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, after one another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def collected(batches) -> pa.Table | None:
    """All rows of one task, if there are any."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of the bytes of ``flat`` as an Arrow binary array; offsets count items of ``flat``."""
    width = flat.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * width), pa.py_buffer(np.ascontiguousarray(flat))],
    ).cast(pa.binary())
