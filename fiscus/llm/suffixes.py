"""Removal of repeated byte strings by two-stage suffix sorting.

A suffix that is smaller than its successor (the suffix one byte on) is of the first kind. Only
those are sorted directly. All others are induced: scanning the buckets of first bytes in order,
each suffix met puts its predecessor, if that is of the second kind, at the front end of the
predecessor's bucket. The common prefixes of adjacent suffixes then tell which strings repeat.
Suffixes are told apart by their first ``window`` bytes and within their segment only.

The segments that are sorted together come from ``windows``: every shard holds all that can share
a string. Equal segments are one entry that counts as often as it occurs.

A null text is empty. Rows that repeat id and text are occurrences of their strings like any others.

``clean_passages`` sorts words in the same way: each distinct word of a shard is a code of three bytes
(four if there are more than two million) of which only the first is over 127, so a suffix that begins
with a word shares prefixes only with such suffixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm import windows
from fiscus.llm.common import binaries, chunks_of, joined, ranges, record, stored, told_if_small, words_of
from fiscus.llm.windows import NO_ID, word_hashes

WINDOW, GRAM = 400, 24
#: The same for passages, in words.
WORDS, WORD_GRAM = 50, 8
SHARD_BYTES = 1 << 20


def kinds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; ends: where the segments end. The last byte of a segment is not."""
    n = len(data)
    if not n:
        return np.zeros(0, bool)
    edge = np.ones(n, bool)
    edge[:-1] = data[1:] != data[:-1]
    edge[ends - 1] = True
    smaller = np.zeros(n, bool)
    smaller[:-1] = data[:-1] < data[1:]
    smaller[ends - 1] = False
    at = np.flatnonzero(edge)
    return np.repeat(smaller[at], np.diff(np.concatenate([[-1], at])))


def sort_suffixes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """The first ``counts`` suffixes of each segment in order of their first ``window`` bytes (and some that follow them)."""
    small = kinds(data, ends)
    n = len(data)
    # Those of the second kind need their successors: up to the next of the first kind, or the end.
    upcoming = np.full(n + 1, n)
    upcoming[:n][small] = np.flatnonzero(small)
    upcoming = np.minimum.accumulate(upcoming[::-1])[::-1]
    last = np.minimum(np.where(counts > 0, upcoming[np.maximum(starts + counts - 1, starts)], starts - 1), ends - 1)
    member = np.zeros(n + 1, bool)
    member[ranges(starts, last - starts + 1)] = True
    end_of = np.repeat(ends, ends - starts)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    induced = member.copy()
    induced[:n] &= ~small

    direct = np.flatnonzero(member[:n] & small)
    follow = data[np.minimum(direct + 1, n - 1)].astype(np.int64)  # a first-kind suffix has a successor
    bucket = data[direct].astype(np.int64) << 8 | follow
    order = np.argsort(bucket, kind="stable")
    direct, bucket = direct[order], bucket[order]
    raw = data.tobytes()
    stops = np.minimum(direct + window, end_of[direct]).tolist()
    places = direct.tolist()
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            keys = [raw[p:s] for p, s in zip(places[a:b], stops[a:b], strict=True)]
            direct[a:b] = direct[a:b][sorted(range(b - a), key=keys.__getitem__)]
    firsts = np.searchsorted(bucket >> 8, np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(met: np.ndarray, byte: int) -> np.ndarray:
        """Hand predecessors of the second kind to their buckets; those of this bucket are returned."""
        before = met[met > 0] - 1
        before = before[induced[before] & ~first[before + 1]]
        letters = data[before]
        own = before[letters == byte]
        other = letters > byte
        if other.any():
            before, letters = before[other], letters[other]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            cut = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(before)], strict=True):
                waiting[letters[a]].append(before[a:b])
        return own

    # The empty suffix at the end of a segment is the smallest: what stands before it comes first.
    tail = ends[(ends > starts)] - 1
    tail = tail[member[tail]]
    order = np.argsort(data[tail], kind="stable")
    for p in np.split(tail[order], np.flatnonzero(np.diff(data[tail][order])) + 1) if len(tail) else []:
        waiting[data[p[0]]].append(p)
    out = []
    for byte in range(256):
        while waiting[byte]:
            wave = np.concatenate(waiting[byte])
            waiting[byte] = []
            while len(wave):
                out.append(wave)
                wave = induce(wave, byte)
        own = direct[firsts[byte]:firsts[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order; the first has none.

    Where both neighbours are one byte on from another pair of neighbours, the length is one less;
    only the others are compared, eight bytes at once.
    """
    n = len(order)
    prefix = np.zeros(n, np.int64)
    if n < 2:
        return prefix
    before = np.full(len(data), -1)
    before[order[1:]] = order[:-1]
    # In text order.
    at = np.flatnonzero(before >= 0)
    other = before[at]
    chain = np.zeros(len(at), bool)
    chain[1:] = (at[1:] == at[:-1] + 1) & (other[1:] == other[:-1] + 1) & (end_of[at[1:]] == end_of[at[:-1]]) & (end_of[other[1:]] == end_of[other[:-1]])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    found = np.zeros(len(at), np.int64)

    def compare(which: np.ndarray) -> None:
        a, b = at[which], other[which]
        room = np.minimum(end_of[a] - a, end_of[b] - b)
        done = np.zeros(len(which), np.int64)
        open_ = np.arange(len(which))
        while len(open_):
            x = words[a[open_] + done[open_]] ^ words[b[open_] + done[open_]]
            step = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            done[open_] = np.minimum(done[open_] + step, room[open_])
            open_ = open_[(step == 8) & (done[open_] < room[open_])]
        found[which] = done

    heads = np.flatnonzero(~chain)
    compare(heads)
    head = heads[np.cumsum(~chain) - 1]
    found = found[head] - (np.arange(len(at)) - head)
    low = np.flatnonzero(found <= 0)
    low = low[chain[low]]
    if len(low):
        found[low] = 0
        compare(low)
    by_place = np.zeros(len(data), np.int64)
    by_place[at] = found
    prefix[1:] = by_place[order[1:]]
    return prefix


def sorted_windows(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole windows at the first ``counts`` places of each segment in order, and whether each equals the one before it."""
    order = sort_suffixes(data, starts, counts, ends, window)
    end_of = np.repeat(ends, ends - starts)
    order = order[end_of[order] - order >= window]
    asked = np.zeros(len(data), bool)
    asked[ranges(starts, counts)] = True
    order = order[asked[order]]
    return order, common_prefixes(data, order, end_of) >= window


def repeated(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place also starts elsewhere; only the first ``counts`` places of each segment are asked."""
    order, equal = sorted_windows(data, starts, counts, ends, window)
    flags = np.zeros(len(data), bool)
    flags[order[equal]] = True
    flags[order[:-1][equal[1:]]] = True
    return flags


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(k1, k2, spans): bytes of each document that repeated strings of ``window`` bytes cover."""
    own, chosen, count = windows.routed(docs, joined, window, gram, 1, shard_bytes, among_documents=False)
    kept = ["anchor", "segment", "windows", "rows", "cells", "block"]
    dealt = windows.dealt(windows.contents(docs, chosen, joined, window, kept), count)

    def run(batches):
        for rows in windows.shards(batches, 8):
            data, at = joined(rows.column(6).combine_chunks())
            counts = rows.column(2).to_numpy()
            flags = repeated(data, at[:-1], counts, at[1:], window)
            many = rows.column(3).to_numpy() > 1
            flags[ranges(at[:-1][many], counts[many])] = True
            owner = np.repeat(np.arange(len(counts)), np.diff(at))
            a, b = windows.intervals(flags, owner)
            cuts = np.searchsorted(a, at)
            own_at = at[owner[a]] if len(a) else a
            spans = pa.StructArray.from_arrays([pa.array(a - own_at), pa.array(b - own_at), pa.nulls(len(a), pa.int64())], names=["first", "last", "least"])
            some = np.diff(cuts) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts[:-1][some], cuts[-1]).astype(np.int32)), spans)
            pick = pa.array(np.flatnonzero(some))
            yield record(["anchor", "segment", "found"], [rows.column(0).take(pick).combine_chunks(), rows.column(1).take(pick).combine_chunks(), lists])

    results = stored(dealt.mapInArrow(run, "anchor long, segment long, found array<struct<first:long,last:long,least:long>>"), "repeats")
    return windows.spans(own, results, window)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal removed runs, and the bytes that are left."""
    docs = windows.documents(df, id_col, text_col)
    found = stored(find_repeats(docs, window), "spans")

    def run(batches):
        for chunk in chunks_of(batches, windows.CHUNK):
            data, at = joined(chunk.column(1))
            runs = windows.merged(chunk.column(2))
            keep = np.ones(len(data), bool)
            for begin, (s, e) in zip(at, runs, strict=False):
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    keep[begin + a:begin + b] = False
            kept = np.concatenate([[0], np.cumsum(keep)])[at]
            sizes = np.array([len(s) for s, _ in runs])
            spans = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([s for s, _ in runs] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([e for _, e in runs] or [np.zeros(0, np.int64)]))], names=["start", "end"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), spans)
            yield record(["doc_id", "n_bytes", "spans", "kept"], [chunk.column(0), np.diff(at), lists, binaries(data[keep], kept)])

    return docs.join(found, windows.KEY, "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def word_codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Words as bytes of which only the first of each word is over 127, and how many bytes a word has."""
    alphabet, codes = np.unique(values, return_inverse=True)
    width = 3 if len(alphabet) <= 1 << 21 else 4
    letters = codes[:, None] >> (7 * np.arange(width - 1, -1, -1))[None, :] & 127
    letters[:, 0] += 128
    return letters.astype(np.uint8).reshape(-1), width


def earlier_windows(values: np.ndarray, at: np.ndarray, counts: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """The smallest id that has the window of words at each place; ``NO_ID`` where no window is asked or it stands there alone."""
    data, width = word_codes(values)
    order, equal = sorted_windows(data, at[:-1] * width, counts * width, at[1:] * width, window * width)
    heads = np.flatnonzero(~equal)
    least = np.full(len(values), NO_ID)
    if len(order):
        owner = np.repeat(ids, np.diff(at))[order // width]
        smallest = np.minimum.reduceat(owner, heads)[np.cumsum(~equal) - 1]
        words = order % width == 0
        least[order[words] // width] = smallest[words]
    return least


def find_passages(docs: DataFrame, window: int = WORDS, gram: int = WORD_GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(k1, k2, spans): words of each document covered by windows that start in a document with a smaller id."""
    own, chosen, count = windows.routed(docs, word_hashes, window, gram, 8, shard_bytes, among_documents=True)
    kept = ["anchor", "segment", "windows", "least", "cells", "block"]
    dealt = windows.dealt(windows.contents(docs, chosen, word_hashes, window, kept), count)

    def run(batches):
        for rows in windows.shards(batches, 8):
            flat, at = joined(rows.column(6).combine_chunks())
            values, at = flat.copy().view(np.uint64), at // 8
            least = earlier_windows(values, at, rows.column(2).to_numpy(), rows.column(3).to_numpy(), window)
            yield windows.found_spans(rows, least, at)

    results = stored(dealt.mapInArrow(run, windows.FOUND), "passages")
    return windows.spans(own, results, window)


def cut_texts(df: DataFrame, found: DataFrame, id_col: str, text_col: str, bytes_of) -> DataFrame:
    """The rows of ``df`` without the bytes that ``bytes_of(data, at, spans)`` marks; null texts stay null.

    Characters of which any byte is left stay whole. A text of which nothing is left becomes empty.
    """
    where, width = df.columns.index(text_col), len(df.columns)
    text, own_id = F.col(f"c{where}").cast("string"), F.col(f"c{df.columns.index(id_col)}").cast("long")
    plain = df.toDF(*[f"c{i}" for i in range(width)])
    keyed = plain.withColumns({"k1": F.xxhash64(own_id, text), "k2": F.xxhash64(F.lit(1), text, own_id)})

    def run(batches):
        for chunk in chunks_of(batches, windows.CHUNK, where):
            texts = chunk.column(where)
            data, at = joined(texts)
            keep = ~bytes_of(data, at, windows.merged(chunk.column(width)))
            if not keep.all():
                heads = np.flatnonzero(data & 0xC0 != 0x80)
                keep = np.repeat(np.maximum.reduceat(keep, heads), np.diff(np.append(heads, len(data))))
            left = binaries(data[keep], np.concatenate([[0], np.cumsum(keep)])[at]).cast(pa.string())
            left = pa.compute.if_else(texts.is_valid(), left, pa.scalar(None, pa.string()))
            columns = [*chunk.columns[:where], left, *chunk.columns[where + 1:width]]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(width)])

    size = found.agg(F.sum(F.size("spans") * 16 + 64)).first()[0] or 0
    rows = keyed.join(told_if_small(found, size), windows.KEY, "left").select(*plain.columns, "spans")
    return rows.mapInArrow(run, plain.schema).toDF(*df.columns)


def marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of n places that are set in the ranges, which do not overlap."""
    flags = np.zeros(n, bool)
    flags[ranges(starts, ends - starts)] = True
    return flags


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` with their columns, their texts without strings of ``window`` bytes that stand anywhere else.

    All occurrences go. Null texts stay null; a text that repeats entirely becomes empty.
    """
    found = stored(find_repeats(windows.documents(df, id_col, text_col), window), "spans")

    def bytes_of(data, at, spans):
        return marked(len(data), *(np.concatenate([x[i] + a for a, x in zip(at, spans, strict=False)] or [at[:0]]) for i in (0, 1)))

    return cut_texts(df, found, id_col, text_col, bytes_of)


def clean_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """The rows of ``df`` with their columns, their texts without windows of ``window`` words that start in a document with a smaller id.

    The first copy stays, and every byte outside the removed passages: a passage goes from the first
    byte of its first word to the last of its last. Windows are judged on the input. Null texts stay
    null, rows without an id come last, and rows that repeat id and text lose the same.
    """
    found = stored(find_passages(windows.documents(df, id_col, text_col), window, gram), "spans")

    def bytes_of(data, at, spans):
        starts, ends, first = words_of(data, at)
        begin, end = (np.concatenate([x[i] + a for a, x in zip(first, spans, strict=False)] or [at[:0]]) for i in (0, 1))
        return marked(len(data), starts[begin], ends[end - 1])

    return cut_texts(df, found, id_col, text_col, bytes_of)
