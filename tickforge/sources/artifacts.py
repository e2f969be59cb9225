"""Versioned artifacts: models, curves, priors and weights under one folder of the shared store.

Every save writes a new version beside the old ones and names it last, by one appended row of a
small table of pointers. Spark commits that row's file as a whole, so a reader sees the version
before or the new one, never a part, and a save that fails leaves the pointer where it was. A roll
back is a further row that names an older version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "name string, at bigint, version string, fresh boolean"


class Artifacts:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _place(self, name: str, version: str) -> str:
        return f"{self.root}/data/{name}/{version}"

    def _pointers(self, name: str) -> list:
        folder = f"{self.root}/pointers"
        if not self._exists(folder):
            return []
        rows = self.spark.read.schema(POINTER).parquet(folder).where(F.col("name") == name)
        return rows.orderBy("at").collect()  # one row a save

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _point(self, name: str, version: str, fresh: bool) -> None:
        last = self._pointers(name)
        at = max(time.time_ns(), last[-1].at + 1 if last else 0)
        self.spark.createDataFrame([(name, at, version, fresh)], POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")

    def _save(self, name: str, write: Callable[[str], None]) -> str:
        version = uuid.uuid4().hex
        write(self._place(name, version))
        self._point(name, version, True)
        return version

    def save_table(self, name: str, df: DataFrame) -> str:
        """A prior, curves or any other table; returns its version."""
        return self._save(name, df.write.parquet)

    def save_model(self, name: str, model: Any) -> str:
        """A model of Spark ML, or one with a `save(path)` of its own."""
        return self._save(name, model.save)

    def save_value(self, name: str, value: Any) -> str:
        """A small value that JSON can hold, such as weights."""
        return self.save_table(name, self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1))

    def versions(self, name: str) -> list[str]:
        """Versions in the order they were saved."""
        return [r.version for r in self._pointers(name) if r.fresh]

    def current(self, name: str) -> str | None:
        rows = self._pointers(name)
        return rows[-1].version if rows else None

    def roll_back(self, name: str, version: str) -> None:
        if version not in self.versions(name):
            raise KeyError(f"{name} has no version {version}")
        self._point(name, version, False)

    def path(self, name: str, version: str | None = None) -> str:
        version = version or self.current(name)
        if version is None:
            raise KeyError(f"nothing is saved as {name}")
        return self._place(name, version)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(name, version))

    def model(self, name: str, load: Callable[[str], Any], version: str | None = None) -> Any:
        return load(self.path(name, version))

    def value(self, name: str, version: str | None = None) -> Any:
        return json.loads(self.table(name, version).first().value)
