"""Token ids in binary files of directly addressable codes.

An id is split into bytes, the lowest first. Level k of a file holds byte k of all ids that have one,
in order, with a bitmap that tells which of them go on to the next level; a rank directory counts the
set bits before every 256th. The place of an id on the next level is the rank of its bit, so any token
is read by a rank query on each level, without decoding what stands before it.

A file holds whole documents in ascending order of their ids and at least ``FILE_TOKENS`` tokens, but
for the last of a task; it is written under a name of its own attempt and renamed, so tasks can be run
again. The manifest, a table beside the files, names the files that count and where each begins among
all tokens. Layout of a file, little-endian: the magic, then as unsigned 64-bit numbers the tokens n,
the documents m and the levels; m + 1 places where documents begin; m ids and m marks that tell null
ids; then for each level its length, its bytes, its bitmap in 64-bit words and its directory in 32-bit
numbers, each part filled up to 8 bytes.

A null text is empty; a document of an empty text holds the end id alone. Null ids come first; rows
with equal ids follow one another in the order of their texts' hashes; rows that repeat are all
written. An empty table gives a manifest without rows.
"""

from __future__ import annotations

import functools
import json
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscus.llm.bpe import KeptWords
from fiscus.llm.common import SPACES, binaries, chunks_of, joined, partitions, prefix_sums, ranges, record, slice_hashes, stored, words_of
from fiscus.session import shared_folder

MAGIC = b"TOKDAC01"
FILE_TOKENS = 1 << 21
#: Bytes of text that are encoded at once, and in one task.
CHUNK, TASK_BYTES = 2 << 20, 16 << 20
BLOCK = 256
FILES = "part long, file long, path string, tokens long, docs long"


# --- the codes ---------------------------------------------------------------------------------


def padded(part: bytes) -> bytes:
    return part + bytes(-len(part) % 8)


class Codes:
    """Directly addressable codes of a sequence of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # bytes, bitmap words, directory

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest > 255
            bits = np.packbits(np.concatenate([more, np.zeros(-len(more) % BLOCK, bool)]), bitorder="little").view(np.uint64)
            counts = np.bitwise_count(bits).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            levels.append(((rest & 255).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> 8

    def rank(self, level: int, place: np.ndarray) -> np.ndarray:
        """How many of the bits before each place are set."""
        _, bits, directory = self.levels[level]
        word, found = place >> 6, directory[place // BLOCK].astype(np.int64)
        for back in range(1, BLOCK // 64):
            whole = word - back >= place // BLOCK * (BLOCK // 64)
            found[whole] += np.bitwise_count(bits[word[whole] - back])
        some = place & 63 > 0
        mask = (np.uint64(1) << (place[some] & 63).astype(np.uint64)) - np.uint64(1)
        found[some] += np.bitwise_count(bits[word[some]] & mask)
        return found

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        ids = np.zeros(len(places), np.uint32)
        which, place = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (data, bits, _) in enumerate(self.levels):
            ids[which] |= data[place].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if not on.any():
                break
            which, place = which[on], self.rank(level, place[on])
        return ids

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: one rank query a level, for the rest of a range stands together there too."""
        ids = np.zeros(end - start, np.uint32)
        which = np.arange(end - start)
        for level, (data, bits, _) in enumerate(self.levels):
            ids[which] |= data[start:end].astype(np.uint32) << np.uint32(8 * level)
            word = start >> 6
            on = np.unpackbits(bits[word:(end + 63) >> 6].view(np.uint8), bitorder="little")[start - word * 64:end - word * 64].astype(bool)
            which = which[on]
            if not len(which):
                break
            start = int(self.rank(level, np.array([start]))[0])
            end = start + len(which)
        return ids


class TokenFile:
    """A file's content: its documents and the codes of their ids."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, docs, levels = (int(x) for x in np.frombuffer(content, "<u8", 3, 8))
        place = 32
        self.starts = np.frombuffer(content, "<u8", docs + 1, place).astype(np.int64)
        place += 8 * (docs + 1)
        self.doc_ids = np.frombuffer(content, "<i8", docs, place)
        place += 8 * docs
        self.null_ids = np.frombuffer(content, np.uint8, docs, place).astype(bool)
        place += docs + -docs % 8
        found = []
        for _ in range(levels):
            size = int(np.frombuffer(content, "<u8", 1, place)[0])
            blocks = -(-size // BLOCK)
            place += 8
            data = np.frombuffer(content, np.uint8, size, place)
            place += size + -size % 8
            bits = np.frombuffer(content, "<u8", blocks * (BLOCK // 64), place)
            place += 8 * len(bits)
            directory = np.frombuffer(content, "<u4", blocks + 1, place)
            place += 4 * len(directory) + -4 * len(directory) % 8
            found.append((data, bits, directory))
        self.codes = Codes(found)


def file_bytes(ids: np.ndarray, sizes: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray) -> bytes:
    """A file of documents with ``sizes`` ids each."""
    codes = Codes.of(ids)
    parts = [MAGIC, np.array([len(ids), len(sizes), len(codes.levels)], "<u8").tobytes()]
    parts += [np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), padded(null_ids.astype(np.uint8).tobytes())]
    for data, bits, directory in codes.levels:
        parts += [np.array([len(data)], "<u8").tobytes(), padded(data.tobytes()), bits.astype("<u8").tobytes(), padded(directory.astype("<u4").tobytes())]
    return b"".join(parts)


# --- encoding ----------------------------------------------------------------------------------


#: Bytes between which a word is cut: letters on one side, marks on the other. The marks leave out the
#: apostrophe, which may take letters to itself, and those of special tokens.
LETTERS, MARKS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~",
))
#: Words of which the tokenizer makes one part, as they are letters or marks throughout.
PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)\Z")
#: Plain words encoded as one text.
TOGETHER = 128


def parts_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of words that are cut between ASCII letters and marks, and the first of each text."""
    starts, ends, first = words_of(data, at)
    if not len(starts):
        return starts, ends, first
    letter, mark = LETTERS[data], MARKS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    cut[starts] = True
    cut[ends] = True
    edges = np.flatnonzero(cut)
    # An edge begins a part unless white space or the end follows it, and ends one unless white space stands before it.
    starts = edges[edges < len(data)]
    starts = starts[~SPACES[data[starts]]]
    ends = edges[edges > 0]
    ends = ends[~SPACES[data[ends - 1]]]
    return starts, ends, np.searchsorted(starts, at)


class Words:
    """Ids of words by a tokenizer that drops white space, so that a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept = KeptWords()
        probe = "a <b 1\té a\n.́ x"
        apart = [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if apart != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this tokenizer's words depend on the white space around them")
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        suffix, vocabulary = content["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        #: Whether a token ends a part of a word; nothing where tokens do not tell.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # Parts cut between letters and marks count as words if the tokenizer cuts there too and no special token is cut.
        probe = "a.b,É-c 'd.e' x!s é_1"
        parts = [i for w in self._cut(probe) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        whole = all(len(self._cut(x["content"])) == 1 for x in content["added_tokens"])
        self.cuts = bool(suffix) and whole and parts == self.tokenizer.encode(probe, add_special_tokens=False).ids

    @staticmethod
    def _cut(text: str) -> list[str]:
        data, at = joined(pa.array([text]))
        starts, ends, _ = parts_of(data, at)
        return [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as slices of bytes, after one another, and how many each has."""
        flat = data.tobytes()
        words = [flat[a:a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        plain = np.fromiter((PLAIN.match(w) is not None for w in words), bool, len(words)) if self.cuts else np.zeros(len(words), bool)
        chosen, alone = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        groups = [chosen[a:a + TOGETHER].tolist() for a in range(0, len(chosen), TOGETHER)]
        found, owners, sizes = [], [], []
        for group, ids in zip(groups, self._ids([" ".join([words[i] for i in g]) for g in groups]), strict=True):
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(group) or ends[-1] != len(ids) - 1:  # not one part each after all
                alone += group
                continue
            found.append(ids)
            owners.append(group)
            sizes.append(np.diff(ends, prepend=-1))
        each = self._ids([words[i] for i in alone])
        found, owners = [*found, *each], np.array([*(i for g in owners for i in g), *alone], np.int64)
        sizes = np.concatenate([*sizes, np.fromiter(map(len, each), np.int64, len(each))])
        counts = np.zeros(len(words), np.int64)
        counts[owners] = sizes
        out = np.zeros(counts.sum(), np.int32)
        out[ranges((np.cumsum(counts) - counts)[owners], sizes)] = np.concatenate([np.zeros(0, np.int32), *found])
        return out, counts

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, each with the end id, and how many each has."""
        data, at = joined(texts)
        starts, ends, first = (parts_of if self.cuts else words_of)(data, at)
        ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(starts):
            code, keys = pd.factorize(slice_hashes(prefix_sums(data), starts, ends))
            some = np.zeros(len(keys), np.int64)
            some[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            known, place, each = self.kept.look_up(self, data, starts[some], (ends - starts)[some], keys)
            counts = each[code]
            ids = known[ranges(place[code], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])[first]
        return np.insert(ids, before[1:], end_id), np.diff(before) + 1


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


# --- files -------------------------------------------------------------------------------------


def opened(folder: str):
    """The file system of a folder and the folder's path in it, whatever Spark calls it."""
    if "://" in folder or folder.startswith("file:"):
        rest = folder.removeprefix("file:") if folder.startswith("file:") else None
        if rest is not None:
            return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


def write(df: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every whole text and write the files; the manifest: path, start, tokens, docs of every file.

    folder: shared by all executors; default: a new one below the cluster's shared folder. ``start`` counts the ids of all files before.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows with equal ids and texts are dealt by their place in the input as well.
    ordered = docs.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(partitions(spark, total, TASK_BYTES), "doc_id", "h", "salt")
    ordered = ordered.sortWithinPartitions("doc_id", "h", "salt").select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def save(batches):
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        coder, waiting, number, part = words(path), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, number
            doc_ids = pa.chunked_array([x[0] for x in waiting]).combine_chunks()
            sizes, ids = (np.concatenate([x[i] for x in waiting]) for i in (1, 2))
            nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
            # Attempts of a task never write to the same file; the one whose manifest rows are kept counts.
            name = f"{base}/tokens-{part:08d}-{number:06d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{name}.part") as out:
                out.write(file_bytes(ids, sizes, doc_ids.fill_null(0).to_numpy(), nulls))
            system.move(f"{name}.part", name)
            row = record(["part", "file", "path", "tokens", "docs"], [np.array([part]), np.array([number]), [name], np.array([len(ids)]), np.array([len(sizes)])])
            waiting, number = [], number + 1
            return row

        for chunk in chunks_of(batches, CHUNK):
            part = chunk.column(2)[0].as_py()
            ids, sizes = coder.encode(chunk.column(1), end_id)
            waiting.append((chunk.column(0), sizes, ids))
            if sum(len(x[2]) for x in waiting) >= file_tokens:
                yield flush()
        if waiting:
            yield flush()

    files = stored(ordered.mapInArrow(save, FILES), "token-files")
    # One row for every two million tokens; sums by task first, then within the task.
    parts = files.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")
    return stored(files.withColumn("inside", inside).join(parts, "part").select("path", (F.col("before") + F.col("inside")).alias("start"), "tokens", "docs"), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document from the files: start counts the ids of all documents before; ids little-endian unsigned 32-bit."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = load(path)
                # A part of the documents at once, as Arrow batches are bounded by what is yielded.
                for a in range(0, len(file.doc_ids), 1024):
                    b = min(a + 1024, len(file.doc_ids))
                    at = file.starts[a:b + 1]
                    ids = file.codes.between(int(at[0]), int(at[-1]))
                    names = pa.array(file.doc_ids[a:b], mask=file.null_ids[a:b])
                    yield record(["doc_id", "start", "ids"], [names, at[:-1] + start, binaries(ids.astype("<u4"), at - at[0])])

    return spread(manifest).select("path", "start").mapInArrow(run, "doc_id long, start long, ids binary")


def tokens_at(manifest: DataFrame, places: DataFrame, place_col: str = "place", bucket: int = FILE_TOKENS) -> DataFrame:
    """(place, id) of any places among all tokens; places outside have no row. Only files that hold some are opened."""
    span = F.expr(f"sequence(start div {bucket}, (start + tokens - 1) div {bucket})")
    files = manifest.withColumn("bucket", F.explode(span))
    wanted = places.select(F.col(place_col).cast("long").alias("place")).where("place >= 0").withColumn("bucket", F.expr(f"place div {bucket}"))
    met = wanted.join(files, "bucket").where("place >= start AND place < start + tokens").select("path", "start", "place")

    def run(batches):
        path, file = None, None
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            which, start, place = names.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                if name != path:
                    path, file = name, load(name)
                some = which == i
                yield record(["place", "id"], [place[some], file.codes.at(place[some] - start[some]).astype(np.int64)])

    # The places of a file are dealt by blocks of it, so that a much asked file is shared by tasks.
    dealt = met.repartition("path", F.expr("place div 65536")).sortWithinPartitions("path")
    return dealt.mapInArrow(run, "place long, id long")


def load(path: str) -> TokenFile:
    system, name = opened(path)
    with system.open_input_file(name) as file:
        return TokenFile(file.read())


def spread(manifest: DataFrame) -> DataFrame:
    """The files over the session's partitions, as many tokens in each as the writing tasks had."""
    spark: SparkSession = manifest.sparkSession
    total = manifest.agg(F.sum("tokens")).first()[0] or 0
    return manifest.repartition(partitions(spark, total, 2 * FILE_TOKENS), "path")


def checksums(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents that were read."""
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
