"""Ignore rules kept as rows: each root has its own globs, and any number of roots shares one plan.

A glob is reduced to the folder that all its matches lie in (``docs/*.md``: ``docs``) and a pattern. Files are joined to
rules by root and folder, for each folder above them down to the deepest one that any rule names, and only then matched; a
rule without such a folder meets all files of its root, as it must. A glob is tried on the path and on the path with
a leading slash; one that is no valid glob is tried below any directory, and is left out if that is none either.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
cloudpickle.register_pickle_by_value(globs)

SPECIAL = set("*?[{\\")


def literal_folder(glob: str) -> str:
    """The folder that holds whatever a glob matches: its parts before the first special one, without the last part."""
    if glob.startswith("/"):
        return literal_folder(glob[1:])
    parts, found = glob.split("/"), []
    for part in parts[:-1]:
        if SPECIAL & set(part):
            break
        found.append(part)
    return "/".join(found)


def compiled(rules: DataFrame, root: str = "root", glob: str = "glob") -> DataFrame:
    """Rows ``root, folder, pattern`` of rows ``root, glob``; blank lines, comments and impossible globs are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").strip()
                if not text or text.startswith("#"):
                    continue
                try:
                    globs.glob_to_regex(text)
                    folder = literal_folder(text)
                except globs.BadGlob:
                    folder = ""
                if pattern := globs.combine([text], fallback_anywhere=True):
                    rows.append((of, folder, pattern))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["root", "folder", "pattern"])

    return rules.select(F.col(root).cast("string").alias("root"), F.col(glob).alias("glob")).mapInArrow(
        run, "root string, folder string, pattern string").distinct()


def ignored_paths(files: DataFrame, rules: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """``root, path`` of the files that a rule of their root ignores. ``rules`` are ``compiled``; a null root has no rules."""
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    deepest = rules.agg(F.coalesce(F.max(depth), F.lit(0)).alias("n")).first()["n"]  # one number
    names = files.select(F.col(root).cast("string").alias("_root"), F.col(path).alias("_path")).distinct()
    bare = F.when(F.startswith("_path", F.lit("/")), F.substring("_path", 2, 1 << 30)).otherwise(F.col("_path"))
    parts = F.split(bare, "/")
    levels = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(deepest))),
                         lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    placed = names.select("_root", "_path", F.explode(levels).alias("_folder"))
    rooted = F.when(F.startswith("_path", F.lit("/")), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path"))
    met = placed.join(rules, (F.col("_root") == F.col("root")) & (F.col("_folder") == F.col("folder")))
    hit = F.rlike("_path", F.col("pattern")) | F.rlike(rooted, F.col("pattern"))
    return met.filter(hit).select(F.col("_root").alias("root"), F.col("_path").alias("path")).distinct()


def not_ignored(files: DataFrame, rules: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """The files that no rule of their root ignores."""
    gone = ignored_paths(files, rules, root, path).select(F.col("root").alias("_root"), F.col("path").alias("_path"))
    return files.join(gone, (files[root].cast("string") == gone["_root"]) & (files[path] == gone["_path"]), "left_anti")
