"""Candidates for repeated windows, found by content so that the work grows with the input alone.

Every window of ``window`` consecutive symbols (bytes or words) has an anchor: the gram in it with
the smallest hash, the leftmost of several. Equal windows have equal anchors, wherever they stand.
Consecutive windows with the same anchor are one run, and the symbols they cover one segment.
Equal segments are one entry with a count and one place where its symbols can be read. Only
segments whose anchor occurs again can hold repeated windows; their symbols are fetched from the
texts and dealt to shards by anchor. A shard therefore sees all segments that can share a window.

A phrase that very many texts share, each with other words around it, would bring all of them
to one anchor. So if an anchor has too many different symbols for one shard, the grams that occur
most around such anchors are counted, and windows are dealt anew with these grams last in the
order: a window then meets others at a common gram only if it holds nothing else. An anchor that
is too large even so is cut into blocks that meet pair by pair, each pair in a cell of its own.

Documents are told apart by a 128-bit hash of id and text; rows that repeat both have one result,
and each of them counts as an occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import chunks_of, collected, joined, partitions, prefix_sums, ranges, record, slice_hashes, stored, words_of

CHUNK = 3 << 20
PLACE_BITS = 21
PART = 1 << 20
#: Common grams that are told to all tasks, at 8 bytes each; what goes beyond stays in the plain order.
COMMON = 1 << 17
PREFIX_BITS = 20
RUNS = "k1 long, k2 long, doc_id long, start long, windows long, anchor long, segment long, again boolean"
KEY = ["k1", "k2"]
SEGMENT = ["anchor", "segment"]
FOUND = "anchor long, segment long, found array<struct<first:long,last:long,least:long>>"
#: Larger than any id of a document.
NO_ID = 2**63 - 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts after one another, and where each text's begin."""
    data, at = joined(texts)
    starts, ends, first = words_of(data, at)
    return (slice_hashes(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, text): every row with its document's key."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "doc_id", "text")


class Grams:
    """A bounded set of grams."""

    def __init__(self, grams=()):
        self.sorted = np.unique(np.asarray(grams, np.uint64))
        self.prefixes = np.zeros(1 << PREFIX_BITS, bool)
        self.prefixes[(self.sorted >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.sorted)

    def hold(self, grams: np.ndarray) -> np.ndarray:
        """Which of the grams are in the set."""
        held = self.prefixes[(grams >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]
        some = np.flatnonzero(held)
        if len(some):
            near = np.minimum(np.searchsorted(self.sorted, grams[some]), len(self.sorted) - 1)
            held[some] = self.sorted[near] == grams[some]
        return held


def runs_of(sums: np.ndarray, at: np.ndarray, window: int, gram: int, common: Grams | None = None):
    """All runs: text, first window, windows, anchor, hash of the segment, whether its anchor stands there twice.

    sums: prefix sums of the symbols of all texts after one another; at: where each text begins;
    common: grams that come last in the order.
    """
    n = len(sums) - 1
    found = []
    wide = window - gram + 1
    sizes = np.diff(at)
    # Only texts with a window: their windows are the symbols but the last window - 1.
    last = at[1:] - window
    for a in range(0, n - window + 1, PART):
        b = min(a + PART, n - window + 1)
        place = np.arange(a, b + wide - 1)
        grams = slice_hashes(sums, place, place + gram)
        order = grams
        if common is not None:
            order = grams >> np.uint64(1) | common.hold(grams).astype(np.uint64) << np.uint64(63)
        least = order >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(place), dtype=np.uint64)
        done = 1
        while done * 2 <= wide:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < wide:
            least = np.minimum(least[:len(least) - (wide - done)], least[wide - done:])
        change = np.ones(b - a, bool)
        np.not_equal(least[1:], least[:-1], out=change[1:])
        begins = at[:-1][(at[:-1] >= a) & (at[:-1] < b)]
        change[begins - a] = True
        ends = (last + 1)[(sizes >= 1) & (last + 1 > a) & (last + 1 < b)]
        change[ends - a] = True
        pos = np.flatnonzero(change)
        anchor = grams[(least[pos] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)]
        pos = pos + a
        text = np.searchsorted(at, pos, side="right") - 1
        fine = pos <= last[text]
        length = np.append(pos[1:], b) - pos
        length = np.minimum(length, np.maximum(last[text] + 1 - pos, 0))
        head = np.ones(len(pos), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fine[:-1]
        head &= fine
        pos, text, anchor, length, head = pos[fine], text[fine], anchor[fine], length[fine], head[fine]
        if not len(pos):
            continue
        heads = np.flatnonzero(head)
        counts = np.add.reduceat(length, heads)
        again = np.diff(np.append(heads, len(pos))) > 1
        found.append((text[heads], pos[heads], counts, anchor[heads], again))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, np.zeros(0, bool)
    text, pos, counts, anchor, again = (np.concatenate(x) for x in zip(*found, strict=True))
    segment = slice_hashes(sums, pos, pos + counts - 1 + window)
    return text, pos - at[text], counts, anchor.view(np.int64), segment.view(np.int64), again


def runs(docs: DataFrame, symbols, window: int, gram: int, common: Grams | None = None) -> DataFrame:
    """The runs of all documents; symbols: (texts) -> (values, where each text's values begin)."""
    told = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for chunk in chunks_of(batches, CHUNK, 3):
            values, at = symbols(chunk.column(3))
            text, start, count, anchor, segment, again = runs_of(prefix_sums(values), at, window, gram, told.value)
            own = chunk.select([0, 1, 2]).take(pa.array(text))
            yield record(["k1", "k2", "doc_id", "start", "windows", "anchor", "segment", "again"], [*own.columns, start, count, anchor, segment, again])

    return docs.mapInArrow(run, RUNS)


def common_grams(docs: DataFrame, full: Grams, symbols, window: int, gram: int, least: int) -> Grams:
    """The grams that stand at least ``least`` times in segments of the anchors ``full``, the most frequent ones first."""
    told = docs.sparkSession.sparkContext.broadcast(full)

    def run(batches):
        for chunk in chunks_of(batches, CHUNK, 3):
            values, at = symbols(chunk.column(3))
            sums = prefix_sums(values)
            text, start, count, anchor, _, _ = runs_of(sums, at, window, gram)
            some = np.flatnonzero(told.value.hold(anchor.view(np.uint64)))
            place = ranges(at[text[some]] + start[some], count[some] + window - gram)
            grams, times = np.unique(slice_hashes(sums, place, place + gram), return_counts=True)
            yield record(["gram", "times"], [grams.view(np.int64), times])

    counts = docs.mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    found = counts.where(F.col("times") >= least).orderBy(F.desc("times"), "gram").limit(COMMON).select("gram").toPandas()
    return Grams(found["gram"].to_numpy(np.int64).view(np.uint64))


def routed(docs: DataFrame, symbols, window: int, gram: int, width: int, shard_bytes: int, among_documents: bool) -> tuple[DataFrame, DataFrame, int]:
    """The members, their distinct segments dealt to shards, and the number of shards."""
    own = members(stored(runs(docs, symbols, window, gram), "runs"), among_documents)
    chosen, count = segments(own, window, width, shard_bytes)
    full = chosen.where("cells > 1").groupBy("anchor").agg(F.max("cells").alias("cells"))
    full = full.orderBy(F.desc("cells"), "anchor").limit(COMMON).select("anchor").toPandas()
    if not len(full):
        return own, chosen, count
    # As many occurrences as fill the part of a shard that one anchor may take.
    least = max(shard_bytes // (2 * window * width), 2)
    common = common_grams(docs, Grams(full["anchor"].to_numpy(np.int64).view(np.uint64)), symbols, window, gram, least)
    if not len(common):
        return own, chosen, count
    own = members(stored(runs(docs, symbols, window, gram, common), "runs"), among_documents)
    return own, *segments(own, window, width, shard_bytes)


def members(found: DataFrame, among_documents: bool) -> DataFrame:
    """The runs whose anchor occurs again: in another document, if so asked, or else anywhere."""
    last = F.lit(2**63 - 1)
    if among_documents:
        again = F.min(F.coalesce("doc_id", last)) < F.max(F.coalesce("doc_id", last))
    else:
        again = (F.count("*") > 1) | F.max("again")
    shared = stored(found.groupBy("anchor").agg(again.alias("keep")).where("keep").select("anchor"), "shared-anchors")
    return stored(found.drop("again").join(shared, "anchor"), "members")


def segments(own: DataFrame, window: int, width: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """Distinct segments with a place to read each, and the shard and block they are dealt to; and the number of shards.

    least: smallest id of its documents (null ids last); rows: how often it occurs. cells is 1, or
    the number of blocks of an anchor that was cut; width: bytes of a symbol.
    """
    last = F.lit(2**63 - 1)
    each = stored(
        own.groupBy(*SEGMENT).agg(
            F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start"), F.first("windows").alias("windows"),
            F.min(F.coalesce("doc_id", last)).alias("least"), F.count("*").alias("rows"),
        ), "segments",
    )
    size = (F.col("windows") + (window - 1)) * width
    sizes = stored(each.groupBy("anchor").agg(F.sum(size).alias("bytes")), "anchor-bytes")
    count = max(partitions(each.sparkSession, 1, 1), -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    cut = stored(sizes.select("anchor", F.ceil(F.col("bytes") * 2 / shard_bytes).cast("int").alias("cells")).where("cells > 1"), "cut-anchors")
    if cut.isEmpty():
        return each.select("*", F.lit(1).alias("cells"), F.lit(0).alias("block")), count
    return (
        each.join(cut, "anchor", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        .withColumn("block", F.expr("cast(pmod(xxhash64(segment), cells) as int)")), count
    )


def contents(docs: DataFrame, chosen: DataFrame, symbols, window: int, kept: list[str]) -> DataFrame:
    """The segments with their symbols as bytes, read from one document each."""
    wanted = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", *[k for k in kept if k != "windows"])).alias("segments"))
    schema = chosen.select(*kept).schema.add("symbols", "binary")

    def run(batches):
        seen = set()  # one of the rows that repeat id and text is enough; the join brings them together
        for chunk in chunks_of(batches, CHUNK, 0):
            own = list(zip(chunk.column(2).to_pylist(), chunk.column(3).to_pylist(), strict=True))
            new = []
            for key in own:
                new.append(key not in seen)
                seen.add(key)
            chunk = chunk.filter(pa.array(new, pa.bool_()))
            values, at = symbols(chunk.column(0))
            lists = chunk.column(1)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            inner = lists.flatten()
            start = at[owner] + inner.field("start").to_numpy()
            end = start + inner.field("windows").to_numpy() - 1 + window
            data = [values[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield record([*kept, "symbols"], [*[inner.field(k) for k in kept], pa.array(data, pa.binary())])

    return docs.join(wanted, KEY).select("text", "segments", *KEY).mapInArrow(run, schema)


def dealt(found: DataFrame, count: int) -> DataFrame:
    """The segments, each shard's in one task; ``shard`` tells the shards and cells of a task apart.

    A segment of block x of an anchor in c blocks goes to the cells min(x, y) * c + max(x, y) of all blocks y.
    Rows that repeat id and text give the same segment again, which is taken once by ``shards``.
    """
    cell = F.expr("explode(transform(sequence(0, cells - 1), x -> least(x, block) * cells + greatest(x, block)))")
    shard = F.when(F.col("cells") == 1, F.pmod(F.xxhash64("anchor"), F.lit(count))).otherwise(F.xxhash64("anchor", "cell"))
    return found.withColumn("cell", cell).withColumn("shard", shard).repartition(count, "shard")


def shards(batches, shard_at: int):
    """The rows of each shard of one task, each segment once."""
    got = collected(batches)
    if got is None:
        return
    shard, anchor, segment = (got.column(i).to_numpy() for i in (shard_at, 0, 1))
    order = np.lexsort((segment, anchor, shard))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (shard, anchor, segment)])
    order = order[~same]
    shard = shard[order]
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield got.take(pa.array(order[a:b]))


def intervals(flags: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of set flags within equal, adjacent groups."""
    on = flags.astype(bool)
    edge = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    begin = on.copy()
    begin[1:] &= ~on[:-1] | edge[1:]
    last = on.copy()
    last[:-1] &= ~on[1:] | edge[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def found_spans(rows: pa.Table, least: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The intervals of adjacent windows of each segment with the same smallest id, where there is one; at: where segments begin."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    a, b = intervals(least < NO_ID, np.cumsum(edge))
    cuts = np.searchsorted(a, at)
    own_at = at[owner[a]] if len(a) else a
    inner = pa.StructArray.from_arrays([pa.array(a - own_at), pa.array(b - own_at), pa.array(least[a])], names=["first", "last", "least"])
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), inner)
    return record(["anchor", "segment", "found"], [rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), lists])


def spans(own: DataFrame, results: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): the symbols of each document that repeated windows cover, as (start, end) in any order.

    results: anchor, segment, found: array of (first, last, least): windows first to last - 1 repeat, and
    the smallest other id is least (null: whatever the id).
    """
    places = own.select(*KEY, "doc_id", "start", *SEGMENT).distinct()
    fine = F.expr("filter(found, x -> x.least IS NULL OR x.least < coalesce(doc_id, 9223372036854775807))")
    moved = F.expr(f"transform(fine, x -> named_struct('start', start + x.first, 'end', start + x.last + {window - 1}))")
    return (
        places.join(results, SEGMENT).withColumn("fine", fine).where("size(fine) > 0").select(*KEY, moved.alias("moved"))
        .groupBy(*KEY).agg(F.flatten(F.collect_list("moved")).alias("spans"))
    )


def merged(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document, its spans joined where they touch or overlap, in order."""
    found = []
    offsets, inner = lists.offsets.to_numpy(), lists.values
    starts, ends = inner.field("start").to_numpy(zero_copy_only=False), inner.field("end").to_numpy(zero_copy_only=False)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for a, b, there in zip(offsets, offsets[1:], valid, strict=False):
        if not there or a == b:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        order = np.argsort(starts[a:b], kind="stable")
        s, e = starts[a:b][order], np.maximum.accumulate(ends[a:b][order])
        head = np.concatenate([[True], s[1:] > e[:-1]])
        found.append((s[head], e[np.append(np.flatnonzero(head)[1:] - 1, len(e) - 1)]))
    return found
