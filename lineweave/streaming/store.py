"""A levelled store of review entries: appended to by batches, compacted by size, read through a manifest.

A batch appends one segment, a table bucketed by path with one entry a path. All segments have the same buckets, so that
looking up keys moves the keys, not the store. Segments of one size class (a power of ``FANOUT`` in rows) are merged
when there are ``FANOUT`` of them. Entries of files that arrive again are merged away, so the segments that a lookup reads
are bounded by the number of paths (``FANOUT`` for each size class), not by the number of batches; and an entry is rewritten
once for each class it rises through. A manifest names the live segments. It is a small file that is written
whole under a new version, so a failed writer leaves the last state; one writer at a time.

Every entry has the version it was written under (``seq``), which says what is newest; merges may take any segments.
Segments are external tables of the session's catalog, because Spark knows buckets of tables only. Bucketed segments
are joined, never put together by a union that is then grouped: Spark 4.1 takes the buckets of such a union for its
partitions and does not shuffle it, and paths of several segments would stay apart.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.incremental import KEY_COLUMNS, STORE_COLUMNS, store_schema
from ..session import Folder

FANOUT = 4
KEPT_MANIFESTS = 2
NAMED_PATHS = 200  # a lookup of no more paths names them in the scan, which then opens their buckets only
ENTRY_COLUMNS = (*STORE_COLUMNS, "seq")


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int

    @property
    def size_class(self) -> int:
        level, rows = 0, self.rows
        while rows >= FANOUT:
            rows //= FANOUT
            level += 1
        return level


class ReviewStore:
    """The store below ``path``; ``buckets`` is settled when it is created, by default as the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self._folder = Folder(spark, f"{self.path}/manifest")
        self._prefix = "review_store_" + hashlib.sha256(self.path.encode()).hexdigest()[:12]
        self.version, self.segments = 0, ()
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.refresh()

    # --- manifest ---

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._folder.names() if n.endswith(".json") and n[:-5].isdigit())

    def refresh(self) -> None:
        if versions := self._versions():
            state = json.loads(self._folder.read(f"{versions[-1]:012d}.json"))
            self.version, self.buckets = state["version"], state["buckets"]
            self.segments = tuple(Segment(**s) for s in state["segments"])

    def _commit(self, segments: tuple[Segment, ...]) -> None:
        state = {"version": self.version + 1, "buckets": self.buckets, "segments": [asdict(s) for s in segments]}
        self._folder.write(f"{self.version + 1:012d}.json", json.dumps(state))
        self.version, self.segments = self.version + 1, segments
        for old in self._versions()[:-KEPT_MANIFESTS]:
            self._folder.delete(f"{old:012d}.json")

    # --- reading ---

    def _table(self, name: str) -> str:
        return f"{self._prefix}_{name.replace('-', '_')}"

    def _location(self, name: str) -> str:
        return f"{self.path}/segments/{name}"

    def _segment(self, name: str) -> DataFrame:
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({store_schema()}, seq bigint) USING parquet CLUSTERED BY (path) "
                           f"SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{self._location(name)}'")
        return self.spark.table(table)

    def entries(self, without: str | None = None) -> DataFrame:
        """All live entries, older ones of a path too."""
        return self._rows([s.name for s in self.segments if s.name != without])

    def _rows(self, names: list[str]) -> DataFrame:
        schema = f"{store_schema()}, seq bigint"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._location(n) for n in names])

    def current(self, columns: tuple[str, ...] = STORE_COLUMNS) -> DataFrame:
        """The newest entry of each path."""
        return newest(self.entries(), columns)

    def known(self, keys: DataFrame, count: int, without: str | None = None) -> DataFrame:
        """The newest keys and version of the ``count`` paths in ``keys``, which may be few; only what is found is shuffled."""
        names = [s.name for s in self.segments if s.name != without]
        if not names:
            return self.entries(without).select(*KEY_COLUMNS, "ruleset_version")
        rows = [self._segment(n).select(*KEY_COLUMNS, "ruleset_version", "seq") for n in names]
        if count <= NAMED_PATHS:
            named = [r["path"] for r in keys.select("path").collect()]
            found = [r.filter(F.col("path").isin(named)) for r in rows]
        else:
            found = [r.join(keys.select("path"), "path", "left_semi") for r in rows]
        return newest(reduce(DataFrame.union, found).repartition("path"), (*KEY_COLUMNS, "ruleset_version"))

    def compared(self, listing: DataFrame) -> DataFrame:
        """``listing`` (unique paths, of any number) with ``known``: the newest entry's version, keys and ``seq``, or null.

        The listing is shuffled into the buckets once; segments are joined to it where they lie.
        """
        kept, found = listing, []
        for n, segment in enumerate(self.segments):
            entry = F.struct("seq", "ruleset_version", "size", "modified", "content_hash")
            rows = self._segment(segment.name).select(F.col("path").alias(f"_path{n}"), entry.alias(f"_known{n}"))
            kept = kept.join(rows, kept["path"] == rows[f"_path{n}"], "left").drop(f"_path{n}")
            found.append(F.col(f"_known{n}"))
        none = F.lit(None).cast("struct<seq:bigint,ruleset_version:string,size:bigint,modified:timestamp,content_hash:string>")
        return kept.withColumn("known", F.greatest(*found, none, none)).drop(*[f"_known{n}" for n in range(len(found))])

    # --- writing ---

    def _write(self, entries: DataFrame, name: str) -> None:
        (entries.write.mode("overwrite").bucketBy(self.buckets, "path").sortBy("path")
         .option("path", self._location(name)).saveAsTable(self._table(name)))

    def append(self, entries: DataFrame, name: str, rows: int) -> None:
        """Add (or, when a batch runs again, replace) one segment of entries in store layout."""
        others = tuple(s for s in self.segments if s.name != name)
        if rows:
            marked = entries.select(*STORE_COLUMNS, F.lit(self.version + 1).cast("bigint").alias("seq"))
            self._write(marked.repartition(self.buckets, "path"), name)  # a file a bucket
            self._commit((*others, Segment(name, rows)))
        elif len(others) < len(self.segments):
            self._commit(others)

    def compact(self, without: str | None = None) -> int:
        """Merge size classes that are full, smallest first; how many merges it took. ``without`` may still be replaced."""
        merges = 0
        while True:
            classes: dict[int, list[Segment]] = {}
            for s in self.segments:
                if s.name != without:
                    classes.setdefault(s.size_class, []).append(s)
            full = sorted(c for c, members in classes.items() if len(members) >= self.fanout)
            if not full:
                return merges
            merged, name = classes[full[0]], f"m{self.version + 1:012d}"
            self._write(newest(self._rows([s.name for s in merged]), ENTRY_COLUMNS), name)
            rest = tuple(s for s in self.segments if s not in merged)
            self._commit((*rest, Segment(name, self._segment(name).count())))
            merges += 1

    def vacuum(self) -> list[str]:
        """Delete segments that no kept manifest names; their names."""
        named = {s["name"] for v in self._versions() for s in json.loads(self._folder.read(f"{v:012d}.json"))["segments"]}
        folder = Folder(self.spark, f"{self.path}/segments")
        dead = [n for n in folder.names() if n not in named]
        for name in dead:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            folder.delete(name)
        return dead


def newest(entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row a path: that of the largest ``seq``."""
    return entries.groupBy("path").agg(F.max_by(F.struct(*columns), "seq").alias("_e")).select("_e.*")
