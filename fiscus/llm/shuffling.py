"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly over buckets that fit in memory, by a seeded hash of
each record's id and place in its input, so that equal ids and texts spread like any others.
Pass two shuffles each bucket (Fisher-Yates, seeded by the bucket) and writes it. The buckets
after one another are a random order of all records; every shard is a contiguous part of it,
and the counts of two shards differ by one at most.

Null texts are empty in size and checksum and stay null in the shards; repeated rows are rows of
their own. ``write`` keeps all columns; columns named like the operator's own (``shard``, ``slot``) raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.llm.common import collected, stored

SHARDS, SEED = 16, 20240229
#: UTF-8 bytes of text that one bucket holds on average.
BUCKET_BYTES = 24 << 20
LAW = "rows"


def shuffle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with its ``shard`` and its ``slot`` there, stored in shuffled order."""
    if clash := {"shard", "slot", "__bucket", "__place", "__first"} & set(df.columns):
        raise ValueError(f"rename the columns {sorted(clash)} before the shuffle")
    total = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(64))).first()[0] or 0
    buckets = max(math.ceil(total / bucket_bytes), 1)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    schema = T.StructType([*df.schema.fields, T.StructField("__bucket", T.IntegerType()), T.StructField("__place", T.LongType())])

    def run(batches):
        own = TaskContext.get().partitionId()
        rows = collected(batches)
        if rows is None:
            return
        order = np.random.Generator(np.random.Philox(key=[seed, own])).permutation(rows.num_rows)
        mixed = rows.take(pa.array(order))
        mixed = mixed.append_column("__place", pa.array(np.arange(rows.num_rows), pa.int64()))
        yield from mixed.to_batches(max_chunksize=2000)

    scattered = df.withColumn("__bucket", bucket).repartitionById(buckets, F.col("__bucket"))
    mixed = stored(scattered.mapInArrow(run, schema), "buckets")
    counts = stored(mixed.groupBy("__bucket").agg(F.count("*").alias("n")), "bucket-rows")
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    # The first (n % shards) shards have one row more than the others.
    low, more = n // shards, n % shards
    at = F.col("__first") + F.col("__place")
    edge = more * (low + 1)
    shard = F.when(at < edge, F.floor(at / (low + 1))).otherwise(more + F.floor((at - edge) / max(low, 1)))
    begin = F.when(F.col("shard") < more, F.col("shard") * (low + 1)).otherwise(edge + (F.col("shard") - more) * low)
    placed = mixed.join(stored(first, "bucket-starts"), "__bucket").withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", (at - begin).cast("long")).drop("__bucket", "__place", "__first")


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards as Parquet folders ``shard=0``, ``shard=1``, ... below ``path`` and return them."""
    shuffle(df, id_col, text_col, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)
