"""Where files come from: a directory tree, or a table with a text column."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

TREE_SCHEMA = "path string, size bigint, modified timestamp, content binary"


@dataclass
class FileBatch(InputPartition):
    files: tuple

    def __init__(self, files):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    """Lists a tree once (names and sizes only) and reads the bytes in tasks."""

    def __init__(self, options):
        self.root = options["path"]
        self.hidden = str(options.get("includeHidden", "false")).lower() == "true"
        self.read_bytes = int(options["readBytes"]) if options.get("readBytes") else None
        self.batch_bytes = int(options.get("batchBytes", 64 * 1024 * 1024))

    def _filesystem(self):
        from pyarrow import fs
        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root

    def partitions(self):
        import os

        from pyarrow import fs
        filesystem, base = self._filesystem()
        local = isinstance(filesystem, fs.LocalFileSystem)
        base = base.rstrip("/")
        batches, batch, weight, pending = [], [], 0, [base]
        while pending:
            for info in filesystem.get_file_info(fs.FileSelector(pending.pop())):
                if info.base_name.startswith(".") and not self.hidden:
                    continue
                if local and os.path.islink(info.path):
                    continue
                if info.type == fs.FileType.Directory:
                    pending.append(info.path)
                elif info.type == fs.FileType.File:
                    batch.append((info.path, info.path[len(base) + 1:], info.size, info.mtime))
                    weight += min(info.size, self.read_bytes or info.size) + 4096
                    if weight >= self.batch_bytes:
                        batches.append(FileBatch(tuple(batch)))
                        batch, weight = [], 0
        return batches + [FileBatch(tuple(batch))]

    def read(self, partition) -> Iterator[tuple]:
        filesystem, _ = self._filesystem()
        for full, relative, size, modified in partition.files:
            try:
                with filesystem.open_input_stream(full) as stream:
                    # three bytes more tell a character cut at the limit from bytes that are no text
                    data = stream.read(self.read_bytes + 3) if self.read_bytes else stream.readall()
            except OSError:  # gone or closed to us: the row stays, without content, and becomes a diagnostic
                data = None
            yield relative, size, modified, data


class TreeSource(DataSource):
    """``spark.read.format("source_tree")``: every regular file below a directory.

    Spark's own ``binaryFile`` listing drops names that start with ``_`` or ``.``, which
    would lose ``__init__.py`` and hidden files.  ``readBytes`` reads only that many bytes
    of each file, and three more to complete a character.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, include_hidden: bool = False,
              read_bytes: int | None = None) -> DataFrame:
    """``path, size, modified, content`` of the regular files below ``root``."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("includeHidden", str(include_hidden).lower())
    if read_bytes:
        reader = reader.option("readBytes", str(read_bytes))
    return reader.load(root)


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    """The same layout from Spark's ``binaryFile`` source, for trees without ``_`` names.

    ``length`` and ``modificationTime`` filters and the pruning of ``content`` reach the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.substr("path", F.instr("path", prefix) + F.lit(len(prefix)))
    return files.select(relative.alias("path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"), "content")


def table_as_files(table: DataFrame, path: Column, text: str, modified: Column | None = None,
                   language: Column | None = None) -> DataFrame:
    """A table of texts seen as files: ``path, size, modified, language, content``."""
    when = F.lit(None).cast("timestamp") if modified is None else modified
    lang = F.lit(None).cast("string") if language is None else language
    return table.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), when.alias("modified"),
                        lang.alias("language"), F.col(text).alias("content"))
