"""Derived data that is kept: made once for each version of its inputs, and found again afterwards.

Everything has a key that names all it depends on: the version of the data, the inputs, the settings.
It is written to a folder of its own; a small file created last, which can be created only once, says
which folder counts. A run that fails leaves nothing that can be found, and of two runs that make the
same thing at once both go on with the folder of the first.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from fiscus.session import shared_base
from fiscus.sources import files

CURRENT = "CURRENT"
#: Within one driver a thing is made once, and who else wants it waits.
_MAKING: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


class Store:
    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark = spark
        self.base = (base or f"{shared_base(spark)}/kept").rstrip("/")

    def place(self, kind: str, *depends_on) -> str:
        """The folder of a kind of thing and all it depends on."""
        told = json.dumps(depends_on, sort_keys=True, ensure_ascii=False)
        return f"{self.base}/{kind}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def find(self, place: str) -> str | None:
        if not files.exists(self.spark, f"{place}/{CURRENT}"):
            return None
        return f"{place}/{files.read_text(self.spark, f'{place}/{CURRENT}')}"

    def get(self, place: str, make: Callable[[str], object]) -> str:
        """The folder that counts; ``make`` fills one first if there is none."""
        found = self.find(place)
        if found is not None:
            return found
        with _MAKING[place]:
            found = self.find(place)
            if found is None:
                name = uuid.uuid4().hex
                make(f"{place}/{name}")
                files.create_once(self.spark, f"{place}/{CURRENT}", name)
                found = self.find(place)
        return found

    def model(self, kind: str, depends_on, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """A stored pipeline; it is fitted only if none is stored under its key."""
        place = self.place(kind, depends_on)
        return PipelineModel.load(self.get(place, lambda path: fit().write().save(path)))
