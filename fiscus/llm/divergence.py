"""How sources of a language differ in their terms: chi-square divergences by three-dimensional cube partitioning.

The work of comparing all groups (the sources of a language) on all terms is a cube: group by group
by term. It is cut into cells of a block of groups, a block of groups and a block of terms. A cell's
task owns its part of the cube: it holds the two slices of the counts it needs, which are copied to
the cells of their row and column, and gives partial sums; adding these along the term axis gives the
divergences. A cell's size is bounded by ``GROUPS`` and ``TERMS`` whatever the size of a source, because
counts are added up before they are dealt.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, only A-Z lower-cased. A language keeps the terms that stand in
at least ``least`` of its documents. With N the occurrences of kept terms and V their number,
``p = 1 + floor(10^9 (count + 1) / (N + V))`` and the divergence of p from q is the sum over kept terms
of ``floor((p - q)^2 / q)``. All of it is exact in 64-bit integers up to 10^9 kept terms and 9 * 10^13
occurrences.

Null texts, languages and sources are empty strings. Every row is a document, rows that repeat included.
Groups without terms take part with counts of zero; a language without kept terms has divergences of 0;
equal values rank by the UTF-8 bytes of the item. An empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.llm.common import chunks_of, joined, prefix_sums, ranges, record, slice_hashes, stored, words_of

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Groups and terms on the sides of a cell.
GROUPS, TERMS = 32, 16_384
CHUNK = 4 << 20

BREAKS = np.ones(256, bool)
BREAKS[ord("A"):ord("Z") + 1] = BREAKS[ord("a"):ord("z") + 1] = BREAKS[128:] = False


def terms_in(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, source, term, count, docs) of the texts of a batch of (lang, source, text)."""
    data, at = joined(batch.column(2))
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    starts, ends, first = words_of(data, at, BREAKS)
    if not len(starts):
        return None
    code, keys = pd.factorize(slice_hashes(prefix_sums(data), starts, ends))
    some = np.zeros(len(keys), np.int64)
    some[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    names = [batch.column(i).dictionary_encode() for i in (0, 1)]
    lang, source = (x.indices.to_numpy() for x in names)
    group = lang.astype(np.int64) * len(names[1].dictionary) + source
    in_doc, counts = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(first)) * len(keys) + code, return_counts=True)
    each, back = np.unique(group[in_doc // len(keys)] * len(keys) + in_doc % len(keys), return_inverse=True)
    term, group = some[each % len(keys)], each // len(keys)
    sizes = (ends - starts)[term]
    flat = data[ranges(starts[term], sizes)]
    texts = pa.StringArray.from_buffers(len(term), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(flat))
    return record(["lang", "source", "term", "count", "docs"], [
        names[0].dictionary.take(pa.array(group // len(names[1].dictionary))), names[1].dictionary.take(pa.array(group % len(names[1].dictionary))), texts,
        np.bincount(back, counts).astype(np.int64), np.bincount(back).astype(np.int64),
    ])


def term_counts(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(lang, source, term, count, docs) of a table of (lang, source, text): added up in the tasks before the shuffle."""

    def run(batches):
        for chunk in chunks_of(batches, chunk_bytes, 2):
            found = terms_in(chunk)
            if found is not None:
                yield found

    rows = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) without leaving 64 bits: four digits, then the other five."""
    more = count + F.lit(1)
    part = F.call_function("mod", more * F.lit(10_000), total)
    return F.lit(1) + whole(more * F.lit(10_000), total) * F.lit(100_000) + whole(part * F.lit(100_000), total)


def whole(a: Column, b: Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), q)


def cell(rows: pa.Table, side: int = GROUPS) -> pa.Table:
    """Partial sums of one cell, less what every term would add if it stood in neither group.

    rows: gi, gj, gno, p0, term, p; a row without a term only names a group. A group without a row for a
    term has the share p0 there; side: how many groups are in a block.
    """
    lang = rows.column("lang")[0]
    low, high = rows.column("gi")[0].as_py(), rows.column("gj")[0].as_py()
    gno = rows.column("gno").to_numpy()
    groups, at = np.unique(gno, return_inverse=True)
    plain = np.zeros(len(groups), np.int64)
    plain[at] = rows.column("p0").to_numpy()
    term = rows.column("term").combine_chunks()
    there = term.is_valid().to_numpy(zero_copy_only=False)
    coded = term.filter(pa.array(there)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    width = len(coded.dictionary)
    shares = np.repeat(plain[:, None], width, axis=1)
    shares[at[there], coded.indices.to_numpy()] = rows.column("p").filter(pa.array(there)).to_numpy()
    block = groups // side
    out_a, out_b, out_v = [], [], []
    for i in np.flatnonzero(block == low):
        others = np.flatnonzero((block == high) & (groups > groups[i]))
        if not len(others):
            continue
        square = (shares[others] - shares[i]) ** 2
        base = (plain[others] - plain[i]) ** 2
        for a, b, value, less in (
            (np.full(len(others), groups[i]), groups[others], square // shares[others], base // plain[others]),
            (groups[others], np.full(len(others), groups[i]), square // shares[i], base // plain[i]),
        ):
            out_a.append(a)
            out_b.append(b)
            out_v.append(value.sum(axis=1) - less * width)
    a, b, v = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_v))
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "gno": a, "other": b, "part": v})


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, side: int = GROUPS, width: int = TERMS, chunk_bytes: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part ``pair``: the divergence of each source from each other one of its language, largest first;
    part ``term``: the ``top`` terms of which a source has more than its language, by their divergence. side, width: groups and terms on the sides of a cell.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts = stored(term_counts(docs, chunk_bytes), "term-counts")
    kept = stored(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least).drop("docs"), "kept-terms"
    )
    entries = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = stored(
        docs.select("lang", "source").distinct()
        .join(entries.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("gno"),
            F.ceil(F.count("*").over(Window.partitionBy("lang")) / side).cast("int").alias("blocks"), F.ceil(F.coalesce("v", F.lit(0)) / width).cast("int").alias("slices"),
        )
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n") + F.col("v")))), "groups",
    )
    shared = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n") + F.col("v")))

    # Slices copied to the cells of their row and column of the cube.
    names = ["lang", "gno", "blocks", "p0", "term", "p", "slice"]
    slices = shared.withColumn("slice", F.expr("cast(pmod(xxhash64(term), slices) as int)")).select(*names)
    roster = groups.where("v > 0").select("lang", "gno", "blocks", "p0", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
    block = f"cast(gno div {side} as int)"
    cells = (
        slices.union(roster).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"gi": F.expr(f"least({block}, other)"), "gj": F.expr(f"greatest({block}, other)")})
    )
    parts = cells.groupBy("lang", "gi", "gj", "slice").applyInArrow(lambda rows: cell(rows, side), "lang string, gno long, other long, part long")
    sums = parts.groupBy("lang", "gno", "other").agg(F.sum("part").alias("part"))
    them = groups.select("lang", F.col("gno").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = (
        groups.select("lang", "source", "gno", "v", "p0").join(them, "lang").where("gno != other").join(sums, ["lang", "gno", "other"], "left")
        .withColumn("value", F.coalesce(F.col("part") + F.col("v") * distance(F.col("p0"), F.col("q0")), F.lit(0)))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = (
        shared.withColumn("q", share(F.col("total"), F.col("lang_n") + F.col("v"))).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    )
    return pairs.union(terms)
