"""Versions of a corpus that write only what changed.

Version 0 is a table of files that was there before. Each later version is a folder with the files that it changed, and a
manifest that names the folders in order. Reading a version takes each path from the newest folder that has it. The paths of
changed files are few columns, so that texts that did not change are neither rewritten nor, unless most of the corpus changed,
shuffled. A version that failed before its manifest was written does not exist; one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixes import fix_files
from ..session import Folder


class CorpusVersions:
    """Versions below ``path`` of the Parquet table of files at ``base`` (``path, language, content`` and more)."""

    def __init__(self, spark: SparkSession, path: str, base: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, f"{self.path}/manifest")
        if not (known := self._versions()):
            if base is None:
                raise FileNotFoundError(f"no corpus below {path}")
            self._folder.write(f"{0:06d}.json", json.dumps({"base": base, "folders": []}))
        elif base is not None and self._state(known[-1])["base"] != base:
            raise ValueError(f"the corpus below {path} has another base")

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._folder.names() if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, version: int) -> dict:
        return json.loads(self._folder.read(f"{version:06d}.json"))

    @property
    def version(self) -> int:
        return self._versions()[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The whole corpus at a version, in the columns of its base."""
        state = self._state(self.version if version is None else version)
        base = self.spark.read.parquet(state["base"])
        if not state["folders"]:
            return base
        changed = self._changed(state, base)
        kept = base.join(changed.select("path"), "path", "left_anti")
        return kept.select(base.columns).unionByName(changed.select(base.columns))

    def _changed(self, state: dict, base: DataFrame) -> DataFrame:
        """The newest text of each path that a version changed."""
        parts = [self.spark.read.schema(base.schema).parquet(f"{self.path}/{name}").withColumn("_n", F.lit(n))
                 for n, name in enumerate(state["folders"])]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) == 1:
            return rows.drop("_n")
        last = rows.groupBy("path").agg(F.max("_n").alias("_last"))  # names only
        return rows.join(last, "path").filter("_n = _last").drop("_n", "_last")

    def commit(self, changed: DataFrame) -> int:
        """A new version in which the files of ``changed`` (columns of the base, paths unique) replace or join those before."""
        version = self.version + 1
        base = self.spark.read.parquet(self._state(version - 1)["base"])
        name = f"v{version:06d}"
        changed.select(base.columns).write.mode("overwrite").parquet(f"{self.path}/{name}")
        state = self._state(version - 1)
        self._folder.write(f"{version:06d}.json", json.dumps({**state, "folders": [*state["folders"], name]}))
        return version

    def fix(self, annotate: bool = False) -> int:
        """A new version with the safe line fixes; only files that they change are written."""
        now = self.read()
        return self.commit(fix_files(now, annotate).withColumn("content", F.col("fixed")).select(now.columns))
