"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a batch are found with array operations, each distinct word once. The symbols of
many words lie in one flat array; a round finds the lowest-ranked pair of every word (ranks by
binary search over the sorted pair keys), merges all of them, and looks up only the pairs that
changed. Words that have no pair left leave the array. Words over ``LONG`` symbols, which would
need as many rounds for one word, are merged with a heap of their pairs instead.

Null texts are empty; an empty text has no ids. Ids equal those of the ``tokenizers`` library
with ``add_special_tokens=False``: the strings of special tokens in a text become their ids.
Distinct words are told apart by a 64-bit hash that covers their bytes and length.
"""

from __future__ import annotations

import functools
import heapq
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from fiscus.llm.common import binaries, chunks_of, ids_and_texts, prefix_sums, ranges, record, slice_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int32(2**31 - 1)
LONG = 200
CHUNK = 3 << 20
#: Words whose ids a task keeps from one batch to the next.
KEPT_WORDS = 1 << 20
#: White space of the pattern, and how far letters and numbers are assigned in Unicode.
SPACE_POINTS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ASSIGNED = 0x34000


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def character_kinds(tokenizer) -> np.ndarray:
    """Kind of each code point, as the tokenizer's own pre-tokenizer groups it between its like."""
    kinds = np.zeros(ASSIGNED + 1, np.uint8)
    points = [c for c in range(ASSIGNED) if not 0xD800 <= c < 0xE000]
    for kind, like in ((LETTER, "a"), (NUMBER, "1")):
        whole = {a for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{like}{chr(c)}{like}#" for c in points)) if b - a == 3}
        kinds[[c for i, c in enumerate(points) if 4 * i in whole]] = kind
    kinds[ord("#")] = OTHER
    kinds[SPACE_POINTS] = SPACE
    return kinds


@dataclass(frozen=True)
class Bpe:
    """A vocabulary as arrays; its size does not depend on the data."""

    first: np.ndarray  # symbol of each byte
    keys: np.ndarray  # sorted pair keys, left << 32 | right
    ranks: np.ndarray  # rank of each key
    made: np.ndarray  # symbol made by each rank
    byte_pairs: np.ndarray  # rank of each pair of bytes
    kinds: np.ndarray
    pieces: np.ndarray  # bytes of all tokens after one another
    piece_at: np.ndarray
    special: tuple[tuple[str, int], ...]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    # --- words ---------------------------------------------------------------------------

    def word_starts(self, points: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Where the pattern's words begin; text_at: where the (non-empty) texts begin."""
        n = len(points)
        kind = self.kinds[np.minimum(points, ASSIGNED)]
        first = np.zeros(n + 3, bool)
        first[text_at] = True
        first[n:] = True
        starts = np.ones(n + 3, bool)
        np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
        starts[:n] |= first[:n]
        # The last white space before something else is a word, or a space that joins what follows.
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        starts[after - 1] = True
        starts[after] = points[after - 1] != 32
        # Shortened words: 's 't 'm 'd 're 've 'll.
        quote = np.flatnonzero(points == 39)
        quote = quote[starts[quote] & ~first[quote + 1]]
        if len(quote):
            ahead = np.concatenate([points, np.zeros(3, points.dtype)])
            one, two = ahead[quote + 1], np.where(first[quote + 2], 0, ahead[quote + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            starts[quote[short | double] + 1] = False
            starts[quote[short] + 2] = True
            starts[quote[double] + 3] = True
        return np.flatnonzero(starts[:n])

    # --- merging -------------------------------------------------------------------------

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as slices of bytes, after one another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = lengths > LONG
        for w in np.flatnonzero(long):
            ids = self._merge_long(self.first[data[starts[w]:starts[w] + lengths[w]]].tolist())
            counts[w] = len(ids)
            done.append((np.full(len(ids), w), np.array(ids, np.int32)))
        word = np.flatnonzero(~long)
        text = data[ranges(starts[word], lengths[word])]
        owner, symbols = np.repeat(word, lengths[word]), self.first[text]
        rank = np.full(len(symbols), NONE)
        if len(symbols):
            rank[:-1] = self.byte_pairs[text[:-1].astype(np.int32) * 256 + text[1:]]
            rank[:-1][owner[1:] != owner[:-1]] = NONE
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(owner)))
            low = np.minimum.reduceat(rank, heads)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((owner[gone], symbols[gone]))
                counts[owner[heads[over]]] = sizes[over]
                owner, symbols, rank, low, sizes = owner[~gone], symbols[~gone], rank[~gone], low[~over], sizes[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            close = np.diff(at) == 1
            if close.any():  # aaa: merge from the left, every other pair of a run
                run = np.concatenate([[0], np.where(close, 0, np.arange(1, len(at)))])
                at = at[(np.arange(len(at)) - np.maximum.accumulate(run)) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))
            owner, symbols, rank = owner[keep], symbols[keep], rank[keep]
            new = np.concatenate([now, now[now > 0] - 1])
            inside = new + 1 < len(owner)
            inside[inside] = owner[new[inside]] == owner[new[inside] + 1]
            rank[new[~inside]] = NONE
            new = new[inside]
            rank[new] = self.rank_of(symbols[new], symbols[new + 1])
        out, at = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
        for owner, symbols in done:
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
            out[ranges(at[owner[heads]], counts[owner[heads]])] = symbols
        return out, counts

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """One long word: a heap of (rank, place), links between the symbols that are left."""
        table = self._dict
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := table.get((a << 32) | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := table.get((symbols[x] << 32) | symbols[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, symbols[x], symbols[after[x]]))
        return [s for s, on in zip(symbols, alive, strict=True) if on]

    @functools.cached_property
    def _dict(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    # --- texts ---------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another (int32), and where each text's ids begin (one more entry at the end)."""
        pieces, owner, lead = [], [], []
        for i, text in enumerate(texts):
            rest = [(text or "", -1)]
            for mark, special in self.special:
                if text and mark in text:
                    rest = [(p, special if k else led) for part, led in rest for k, p in enumerate(part.split(mark))]
            for part, led in rest:
                pieces.append(part)
                owner.append(i)
                lead.append(led)
        flat = "".join(pieces)
        lead_ids, piece_owner = np.array(lead, np.int64), np.array(owner, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_at = np.cumsum(sizes) - sizes
        per_piece = np.zeros(len(pieces), np.int64)
        ids = np.zeros(0, np.int32)
        if flat:
            points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
            data = np.frombuffer(flat.encode(), np.uint8)
            word_at = self.word_starts(points, piece_at[sizes > 0])
            if len(data) == len(points):
                starts = word_at
            else:
                width = np.ones(len(points), np.int8)
                for edge in (0x80, 0x800, 0x10000):
                    width += points >= edge
                starts = (np.cumsum(width, dtype=np.int64) - width)[word_at]
            ends = np.append(starts[1:], len(data))
            code, some, keys = self._distinct(data, starts, ends)
            unique_ids, unique_at, counts = self._kept.look_up(self, data, starts[some], (ends - starts)[some], keys)
            per_word = counts[code]
            ids = unique_ids[ranges(unique_at[code], per_word)]
            first_word = np.searchsorted(word_at, np.append(piece_at, len(points)))
            total = np.concatenate([[0], np.cumsum(per_word)])
            per_piece = np.diff(total[first_word])
        led = lead_ids >= 0
        if led.any():
            ids = np.insert(ids, (np.cumsum(per_piece) - per_piece)[led], lead_ids[led].astype(np.int32))
            per_piece = per_piece + led
        per_text = np.bincount(piece_owner, per_piece, len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each word, the same for equal words; one place and the hash of each number."""
        code, keys = pd.factorize(slice_hashes(prefix_sums(data), starts, ends))
        some = np.zeros(len(keys), np.int64)
        some[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        return code, some, keys

    @functools.cached_property
    def _kept(self) -> KeptWords:
        return KeptWords()

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids' tokens after one another, and where each text's bytes begin."""
        sizes = self.piece_at[ids + 1] - self.piece_at[ids]
        data = self.pieces[ranges(self.piece_at[ids], sizes)]
        return data, np.concatenate([[0], np.cumsum(sizes)])[at]


class KeptWords:
    """Ids of words met before, by sorted hash; emptied when it holds ``KEPT_WORDS``."""

    def __init__(self):
        self.keys, self.at, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, model: Bpe, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray):
        """Ids of the words, where each one's ids begin, and how many each has."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        at, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], counts[known] = self.at[place[known]], self.counts[place[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids, at, counts
        ids, counts[new] = model.merge_words(data, starts[new], lengths[new])
        at[new] = len(self.ids) + np.cumsum(counts[new]) - counts[new]
        all_ids = np.concatenate([self.ids, ids])
        if len(self.keys) + len(new) > KEPT_WORDS:
            self.__init__()
        else:
            keys, order = np.concatenate([self.keys, keys[new]]), None
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at, self.counts = np.concatenate([self.at, at[new]])[order], np.concatenate([self.counts, counts[new]])[order]
            self.ids = all_ids
        return all_ids, at, counts


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """A byte-level BPE file of the ``tokenizers`` library as arrays."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
    right = np.array([vocabulary[b] for _, b in pairs], np.int64)
    made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
    keys = (left << 32) | right
    order = np.argsort(keys)
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    size = max([*vocabulary.values(), *special.values()]) + 1
    texts = [b""] * size
    for token, i in vocabulary.items():
        texts[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    for token, i in special.items():
        texts[i] = token.encode()
    first = np.array([vocabulary[c] for c in letters], np.int32)
    model = Bpe(
        first=first, keys=keys[order], ranks=order.astype(np.int32), made=made,
        byte_pairs=np.zeros(0, np.int32), kinds=character_kinds(Tokenizer.from_file(path)),
        pieces=np.frombuffer(b"".join(texts), np.uint8), piece_at=np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
        special=tuple(sorted(special.items(), key=lambda x: -len(x[0]))),
    )
    table = model.rank_of(np.repeat(first, 256), np.tile(first, 256))
    return Bpe(**{**model.__dict__, "byte_pairs": table})


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: doc_id, ids (little-endian unsigned 32-bit), decoded (bytes).

    One row for each row of ``df``, repeated rows included; a null id stays null.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        model = shared.value
        for chunk in chunks_of(batches, CHUNK):
            ids, at = model.encode(chunk.column(1).to_pylist())
            data, data_at = model.decode(ids, at)
            yield record(["doc_id", "ids", "decoded"], [chunk.column(0), binaries(ids.astype("<u4"), at), binaries(data, data_at)])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_pandas(path: str, texts: pd.Series) -> pa.Array:
    """Ids of a few texts as lists, for use outside Spark."""
    ids, at = load(path).encode(list(texts))
    return pa.array([ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)])
