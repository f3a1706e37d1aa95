"""Tables that change together: all of a commit is seen, or nothing of it.

A root folder holds the tables' data, each piece in a folder of its own, and a log. A log entry is a
small file that names the folders each table consists of; readers take the last one. Writing data
changes nothing that can be read; the entry, created last and under the next number, does. A number
can be taken once, so a writer that started from a state that is no longer the last one notices.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fiscus.operators.filters import align_schema
from fiscus.operators.joins import rows_absent_from
from fiscus.sources import files

LOG = "_commits"


class CommitConflict(RuntimeError):
    """Another writer has committed since the state this commit is based on."""


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        numbers = [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/{LOG}") if n.endswith(".json") and not n.startswith(".")]
        return max(numbers, default=0)

    def _entry(self, version: int) -> str:
        return f"{self.root}/{LOG}/{version:012d}.json"

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The data folders of each table at a version, by default the last."""
        version = self.version() if version is None else version
        return json.loads(files.read_text(self.spark, self._entry(version))) if version else {}

    def read(self, name: str, schema: StructType, version: int | None = None) -> DataFrame:
        """A table at a version; the rows of earlier versions stay readable."""
        parts = [f"{self.root}/{p}" for p in self.folders(version).get(name, [])]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def append(self, rows: Mapping[str, DataFrame], version: int) -> int:
        """Add rows to several tables in one commit on top of ``version``; the new version."""
        state = self.folders(version)
        for name, df in rows.items():
            part = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{part}")
            state[name] = [*state.get(name, []), part]
        if not files.create_once(self.spark, self._entry(version + 1), json.dumps(state, sort_keys=True)):
            raise CommitConflict(f"version {version + 1} of {self.root} is taken")
        return version + 1

    def merge_absent(self, rows: Mapping[str, DataFrame], schemas: Mapping[str, StructType], keys: Sequence[str], tries: int = 10) -> int:
        """Add to every table the rows whose keys it does not have, all in one commit.

        If another writer was faster, what is absent is worked out again from its state.
        """
        for _ in range(tries):
            version = self.version()
            state = self.folders(version)
            new = {}
            for name, df in rows.items():
                missing = align_schema(df, schemas[name])
                if state.get(name):
                    missing = rows_absent_from(missing, self.read(name, schemas[name], version), keys)
                if not missing.isEmpty():
                    new[name] = missing
            if not new:
                return version
            try:
                return self.append(new, version)
            except CommitConflict:
                continue
        raise CommitConflict(f"{tries} other commits came first")
