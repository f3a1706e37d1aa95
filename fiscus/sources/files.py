"""Names and small files of any folder Spark can read, through the driver's Hadoop client."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content; False if the name is taken, and nothing is changed then.

    Of several writers exactly one succeeds: the name is given to a finished file by a link on a
    local disk, and by the file system's own exclusive creation elsewhere.
    """
    system, where = _at(spark, path)
    system.mkdirs(where.getParent())
    if system.getScheme() == "file":
        target = where.toUri().getPath()
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    if system.exists(where):
        return False
    try:
        stream = system.create(where, False)
    except Exception as taken:
        if system.exists(where):
            return False
        raise taken
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    return True


def data_version(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below the paths is added, removed or written; the files themselves are not read."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    seen = there.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("all"),
    ).first()
    return f"{seen['n']}-{(seen['all'] or 0) & (2**64 - 1):016x}"
