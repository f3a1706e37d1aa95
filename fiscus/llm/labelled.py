"""A bounded, deterministic sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, label_col: str, each: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``each`` documents of either label, and how many there are of each.

    ``docs`` has doc_id and text. Ids come by their hash, so the same rows give the same sample
    whatever their order. Null labels or ids and ids with different labels are left out; an id that
    repeats is one document (the smallest text).
    """
    told = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("other"))
        .where("label = other").drop("other")
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    some = None
    for label in (0, 1):
        part = told.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        some = part if some is None else some.union(part)
    # At most 2 * each ids.
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"), counts
