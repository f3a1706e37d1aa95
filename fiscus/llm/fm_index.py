"""Removal of repeated word windows with a compressed FM-index per shard.

A shard's segments are sorted into a suffix array, of which the index keeps the Burrows-Wheeler
transform as a wavelet matrix: one packed bit vector with sampled counts for each bit of a word's
code. Backward search extends a match by one word to the left with two rank queries on every
level. Documents are streamed through it from their ends: the longest match at each place
(matching statistics) follows from the one after it; where a match cannot be extended, its
interval is widened to the next shorter common prefix. Matches are cut to the window, so an
interval of full length stands for one window, and the smallest document id in it is known.

The segments and shards come from ``windows``; many sequences are streamed side by side, one
word of each at a time. Words are told apart by 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null text has none. A null id counts as larger than
any other. Rows that repeat id and text have the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm import windows
from fiscus.llm.common import chunks_of, joined, ranges, record, stored, words_of
from fiscus.llm.windows import NO_ID, word_hashes

WINDOW, GRAM = 50, 8
SHARD_BYTES = 2 << 20


class WaveletMatrix:
    """Rank queries on a sequence of small numbers, one packed bit vector for each bit."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(int(size - 1).bit_length(), 1)
        self.words, self.counts, self.zeros = [], [], []
        starts = np.zeros(size, np.int64)
        symbols = np.arange(size)
        values = values.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            starts = self._step(len(self.words) - 1, symbols >> level & 1, starts)
            values = np.concatenate([values[~bits], values[bits]])
        self.starts = starts

    def _step(self, at: int, bit: np.ndarray, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        ones = self.counts[at][word] + np.bitwise_count(self.words[at][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(bit == 1, self.zeros[at] + ones, place - ones)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        own = place
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            own = self._step(i, symbol >> level & 1, own)
        return own - self.starts[symbol]


class FMIndex:
    """Index over sequences of words; matches never cross sequences and are cut to ``window`` words."""

    def __init__(self, values: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int):
        """values: the words of all sequences after one another; at: where each begins; ids: one for each sequence."""
        self.window = window
        self.alphabet, codes = np.unique(values, return_inverse=True)
        m, sizes = len(at) - 1, np.diff(at)
        n = len(values) + m
        text = np.zeros(n, np.int64)  # a mark, smaller than all words, ends each sequence
        text[ranges(at[:-1] + np.arange(m), sizes)] = codes + 1
        marks = at[1:] + np.arange(m)
        owner = np.repeat(np.arange(m), sizes + 1)
        rank = text + (m - 1)
        rank[marks] = np.arange(m)
        order = np.argsort(rank, kind="stable")
        open_ = np.arange(n)
        ranks, width = [], 0
        while True:
            # A rank is the place of the first suffix with that prefix; only suffixes that share theirs are sorted on.
            some = order[open_]
            further = rank[np.minimum(some + width, n - 1)] if width else np.zeros(len(some), np.int64)
            if width:
                by = np.argsort(rank[some] * n + further)
                some, further = some[by], further[by]
                order[open_] = some
            head = np.ones(len(some), bool)
            head[1:] = (rank[some][1:] != rank[some][:-1]) | (further[1:] != further[:-1])
            new = rank.copy()
            new[some] = open_[np.flatnonzero(head)[np.cumsum(head) - 1]]
            rank = new
            width = max(2 * width, 1)
            if width <= window:
                ranks.append(rank)
            single = head & np.append(head[1:], True)
            open_ = open_[~single]
            if not len(open_):
                break
        self.n = n
        # Common prefixes of neighbours, from the ranks of prefixes of 1, 2, 4, ... words.
        a, b, common = order[1:].copy(), order[:-1].copy(), np.zeros(n - 1, np.int64)
        for power in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if power == len(ranks) - 1 else 1):  # the longest may fit twice
                inside = (a < n) & (b < n)
                same = np.zeros(len(a), bool)
                same[inside] = ranks[power][a[inside]] == ranks[power][b[inside]]
                common[same] += 1 << power
                a[same] += 1 << power
                b[same] += 1 << power
        self.common = np.concatenate([[-1], np.minimum(common, window), [-1]]).astype(np.int32)
        before = np.where(np.isin(order, np.concatenate([[0], marks[:-1] + 1])), 0, text[np.maximum(order, 1) - 1])
        size = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:size]
        self.matrix = WaveletMatrix(before, size)
        self.smaller_before = self._nearest_smaller(self.common)
        self.smaller_after = (len(self.common) - 1 - self._nearest_smaller(self.common[::-1]))[::-1]
        cut = np.flatnonzero(self.common[:-1] < window)
        self.group = np.cumsum(self.common[:n] < window) - 1
        self.least = np.minimum.reduceat(ids[owner[order]], cut)
        short = np.flatnonzero(self.common < window - 1)
        place = np.arange(n + 1)
        self.short_from = short[np.searchsorted(short, place, side="right") - 1]
        self.short_to = short[np.minimum(np.searchsorted(short, place, side="left"), len(short) - 1)]

    @staticmethod
    def _nearest_smaller(values: np.ndarray) -> np.ndarray:
        """The nearest place to the left with a smaller value (the place itself at the left end)."""
        near = np.maximum(np.arange(len(values)) - 1, 0)
        open_ = np.flatnonzero((values[near] >= values) & (near > 0))
        while len(open_):
            near[open_] = near[near[open_]]
            open_ = open_[(values[near[open_]] >= values[open_]) & (near[open_] > 0)]
        return near

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word on the left."""
        both = self.matrix.rank(np.concatenate([code, code]), np.concatenate([low, high])) + np.tile(self.first[code], 2)
        return both[:len(code)], both[len(code):]

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals and lengths of the longest shorter prefixes that more suffixes share."""
        left, right = self.common[low], self.common[high]
        depth = np.maximum(left, right)
        return np.where(left == depth, self.smaller_before[low], low), np.where(right == depth, self.smaller_after[high], high), depth

    def matches(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed sequences: the length of the longest match that starts there (at most
        ``window``), and the smallest id that has it if it is of full length (else ``NO_ID``)."""
        code = np.searchsorted(self.alphabet, values)
        there = code < len(self.alphabet)
        there[there] = self.alphabet[code[there]] == values[there]
        code = np.where(there, code + 1, 0)
        length, least = np.zeros(len(values), np.int64), np.full(len(values), NO_ID)
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = at[1:][order], sizes[order]
        low, high, size = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for step, k in enumerate(active.tolist()):
            place = ends[:k] - 1 - step
            own = code[place]
            new_low, new_high = self.extend(own, low[:k], high[:k])
            size[:k] += 1
            failed = np.flatnonzero((new_low >= new_high) | (own == 0))
            if len(failed):
                unknown = failed[own[failed] == 0]
                low[unknown], high[unknown], size[unknown] = 0, self.n, 0
                new_low[unknown], new_high[unknown] = 0, self.n
                failed = failed[own[failed] != 0]
                while len(failed):
                    wide_low, wide_high, depth = self.widen(low[failed], high[failed])
                    low[failed], high[failed] = wide_low, wide_high
                    size[failed] = depth + 1
                    new_low[failed], new_high[failed] = self.extend(own[failed], wide_low, wide_high)
                    failed = failed[new_low[failed] >= new_high[failed]]
            low[:k], high[:k] = new_low, new_high
            length[place] = size[:k]
            full = np.flatnonzero(size[:k] >= self.window)
            if len(full):
                least[place[full]] = self.least[self.group[low[full]]]
                low[full], high[full] = self.short_from[low[full]], self.short_to[high[full]]
                size[full] = self.window - 1
        return length, least


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(k1, k2, spans): words of each document covered by windows that start in a document with a smaller id."""
    own, chosen, count = windows.routed(docs, word_hashes, window, gram, 8, shard_bytes, among_documents=True)
    kept = ["anchor", "segment", "windows", "least", "cells", "block"]
    dealt = windows.dealt(windows.contents(docs, chosen, word_hashes, window, kept), count)

    def run(batches):
        for rows in windows.shards(batches, 8):
            flat, at = joined(rows.column(6).combine_chunks())
            values, at = flat.copy().view(np.uint64), at // 8
            _, least = FMIndex(values, at, rows.column(3).to_numpy(), window).matches(values, at)
            yield windows.found_spans(rows, least, at)

    results = stored(dealt.mapInArrow(run, windows.FOUND), "matches")
    return windows.spans(own, results, window)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every row: the removed runs of words, and the words left, joined by one space."""
    docs = windows.documents(df, id_col, text_col)
    found = stored(find_repeats(docs, window), "spans")

    def run(batches):
        for chunk in chunks_of(batches, windows.CHUNK):
            data, at = joined(chunk.column(1))
            starts, ends, first = words_of(data, at)
            runs = windows.merged(chunk.column(2))
            keep = np.ones(len(starts), bool)
            for begin, (s, e) in zip(first, runs, strict=False):
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    keep[begin + a:begin + b] = False
            # Each kept word and a space; the last space of a text is left out.
            which = np.flatnonzero(keep)
            size = ends[which] - starts[which] + 1
            out = np.concatenate([data, [np.uint8(32)]])[np.minimum(ranges(starts[which], size), len(data))] if len(which) else np.zeros(0, np.uint8)
            out[np.cumsum(size) - 1] = 32
            words = np.concatenate([[0], np.cumsum(keep)])[first]
            edge = np.concatenate([[0], np.cumsum(size)])[words]
            flat = out.tobytes()
            kept = [flat[a:max(b - 1, a)] for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
            sizes = np.array([len(s) for s, _ in runs])
            spans = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([s for s, _ in runs] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([e for _, e in runs] or [np.zeros(0, np.int64)]))], names=["start", "end"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), spans)
            yield record(["doc_id", "n_words", "spans", "kept"], [chunk.column(0), np.diff(first), lists, pa.array(kept, pa.binary())])

    return docs.join(found, windows.KEY, "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary"
    )
