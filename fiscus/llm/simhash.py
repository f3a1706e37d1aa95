"""SimHash near-dedup by multi-index hashing.

A fingerprint has one bit for each of 64 majorities over the hashes of a text's shingles. Equal
fingerprints are one entry. Each fingerprint is cut into ``segments`` equal parts; two that differ
in at most ``radius`` bits differ in at most ``radius // segments`` bits in some part. So each
one is filed under its own value of each part, probes the small Hamming ball around that value,
and complete distances are verified where a probe meets a file. A file with many entries is cut
into blocks that meet the blocks of its probes pair by pair, so no task gets it whole. Tasks
pass on links that connect what they found connected, never all pairs.

Texts: null has no words, like an empty text; no words gives fingerprint zero, which is linked
like any other. Repeated rows are rows of one group. Null ids are left out of the smallest id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import chunks_of, collected, ids_and_texts, partitions, ranges, record, stored, told_if_small
from fiscus.llm.components import components, forest

BITS = 64
SEED = 42
#: Entries of one block of a file, rows of one task, pairs compared at once.
BLOCK, ROWS, PAIRS = 4096, 400_000, 1 << 21
CHUNK = 4 << 20
#: Where a row meets others: two block numbers of SIDE bits, and as what it is there. All 2^32 fingerprints of a file have a block.
SIDE = 21
AS_FILE, AS_PROBE = 1 << 61, 1 << 60


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of one text, as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i:] for i in range(min(shingle, len(words)))]
    rest = map(b" ".join, zip(*grams, strict=False))
    total, n = np.zeros(BITS, np.int64), 0
    while part := list(itertools.islice(rest, 1 << 16)):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, itertools.repeat(SEED)), np.uint64, len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    def run(batches):
        for chunk in chunks_of(batches, CHUNK):
            values = [fingerprint(t, shingle) for t in chunk.column(1).to_pylist()]
            yield record(["doc_id", "fp"], [chunk.column(0), pa.array(values, pa.int64())])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set; zero first."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def _verified(key: np.ndarray, fp: np.ndarray, place: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of one task; place: the cell of two blocks with AS_FILE or AS_PROBE, or zero for a file in one block."""
    cell = place & ((1 << 2 * SIDE) - 1)
    order = np.lexsort((cell, key))
    key, fp, place, cell = key[order], fp[order], place[order], cell[order]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
    sizes = np.diff(np.append(heads, len(key)))
    begin, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    own = fp.view(np.uint64) >> (np.uint64(width) * (key >> width).astype(np.uint64)) & np.uint64((1 << width) - 1) == (key & ((1 << width) - 1)).astype(np.uint64)
    whole = place == 0
    filed = np.flatnonzero(own & (size > 1) & (whole | (place & AS_FILE != 0)))
    probes = whole | (place & AS_PROBE != 0)
    links_a, links_b = [], []
    load = np.cumsum(size[filed]) // PAIRS
    for part in np.split(filed, np.flatnonzero(np.diff(load)) + 1):
        if not len(part):
            continue
        i, j = np.repeat(part, size[part]), ranges(begin[part], size[part])
        near = probes[j] & (fp[i] != fp[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        if near.any():
            a, b = forest(fp[i[near]], fp[j[near]])
            links_a.append(a)
            links_b.append(b)
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(links_a), np.concatenate(links_b))


def near_links(prints: DataFrame, radius: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits; ``prints`` has distinct ones in ``fp``."""
    width = BITS // segments
    ball = _ball(width, radius // segments)
    spark = prints.sparkSession

    def part_of(s: int):
        return F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(s << width))

    files = prints.select(F.explode(F.array(*[part_of(s) for s in range(segments)])).alias("key"))
    full = files.groupBy("key").count().where(F.col("count") > block)
    # Whatever probes a full file also meets its neighbours' files: those are cut as finely.
    cut = stored(
        full.select(F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(m)) for m in ball])).alias("key"), "count")
        .groupBy("key").agg(F.ceil((F.sum("count") + block) / block).cast("long").alias("cells")),
        "full-files",
    )
    probes = prints.select(
        "fp",
        F.posexplode(F.array(*[part_of(s).bitwiseXOR(F.lit(m)) for s in range(segments) for m in ball])).alias("at", "key"),
    ).select("key", "fp", (F.col("at") % len(ball) == 0).alias("filed"))
    if cut.isEmpty():
        rows = probes.select("key", "fp", F.lit(0).cast("long").alias("place"))
    else:
        block_of = F.pmod(F.xxhash64("fp"), F.col("cells"))
        along = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)

        def cell(x, y, *as_what):
            place = F.shiftleft(x, SIDE).bitwiseOR(y)
            for flag, there in as_what:
                place = place.bitwiseOR(F.when(there, F.lit(flag)).otherwise(F.lit(0).cast("long")))
            return place

        own_block = F.col("block")
        as_probe = F.transform(along, lambda x: cell(x, own_block, (AS_PROBE, F.lit(True)), (AS_FILE, x == own_block)))
        as_file = F.transform(along, lambda y: cell(own_block, y, (AS_FILE, F.lit(True)), (AS_PROBE, y == own_block)))
        rows = (
            probes.join(cut, "key", "left").withColumn("block", F.when(F.col("cells").isNotNull(), block_of))
            .select("key", "fp", F.explode(
                F.when(F.col("cells").isNull(), F.array(F.lit(0).cast("long")))
                .otherwise(F.when(F.col("filed"), F.array_union(as_probe, as_file)).otherwise(as_probe))).alias("place"))
        )
    count = partitions(spark, prints.count() * segments * len(ball), ROWS)

    def run(batches):
        table = collected(batches)
        if table is not None:
            a, b = _verified(*[table.column(i).to_numpy() for i in range(3)], width, radius)
            yield record(["a", "b"], [a, b])

    return rows.repartition(count, "key", F.col("place").bitwiseAND(F.lit((1 << 2 * SIDE) - 1))).mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable by links."""
    rows = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    entries = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    found = components(near_links(entries.select("fp"), radius, block=block)).toDF("fp", "root")
    rooted = entries.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stored(rooted.join(stored(least, "roots"), "root").select("fp", "component_id"), "groups")
    return rows.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group, with their columns as they are.

    An id that repeats is one document, of which the smallest row stays. Rows without an id cannot be named and stay.
    """
    name = "c" + str(df.columns.index(id_col))
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    groups = near_groups(df, id_col, text_col, shingle, radius)
    kept = stored(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    own = F.col(name).cast("long") == F.col("doc_id")
    once = rows.join(told_if_small(kept.where("rows = 1"), 32 * kept.count()), own, "left_semi")
    unnamed = rows.where(F.col(name).isNull())
    done = once.union(unnamed)
    again = kept.where("rows > 1")
    if not again.isEmpty():
        others = [c for c in rows.columns if c != name]
        least = rows.join(again, own, "left_semi").groupBy(name).agg(F.min(F.struct(*others)).alias("row"))
        done = done.union(least.select(*[name if c == name else F.col("row")[c].alias(c) for c in rows.columns]))
    return done.toDF(*df.columns)
