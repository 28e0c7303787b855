import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lineweave.functions.globs import combine
from lineweave.sources import ignore_table, selection
from lineweave.sources.versions import CorpusVersions

GLOBS = ["docs/*.md", "*.log", "**/tmp/**", "/src/gen/**", "a/b/c", "a/{b,c}/*.py", "", "# note", "[", "src/[", "doc?/x", "/abs.txt", "{", "a/b/"]
PATHS = ["docs/a.md", "docs/x/a.md", "a.log", "x/a.log", "tmp/x", "y/tmp/z/w", "src/gen/a", "src/gen", "a/b/c", "a/b/d.py", "a/c/d.py", "/abs.txt",
         "abs.txt", "docs/x", "docz/x", "/src/gen/b", "other", "a/b/", "[", "q/["]


def test_each_root_has_its_own_rules(spark):
    rng = random.Random(3)
    rules = [(f"r{n}", g) for n in range(12) for g in rng.sample(GLOBS, 4)] + [("r3", "*.log"), (None, "**"), ("r5", None)]
    files = [(r, p) for r in [*(f"r{n}" for n in range(13)), None] for p in PATHS]
    want = set()
    for root, path in files:
        pattern = combine([g for r, g in rules if r == root and r is not None and g and not g.startswith("#")], fallback_anywhere=True)
        if pattern and (re.match(pattern.replace("\\z", "\\Z"), path) or re.match(
                pattern.replace("\\z", "\\Z"), path if path.startswith("/") else "/" + path)):
            want.add((root, path))
    table = ignore_table.compiled(spark.createDataFrame(rules, "root string, glob string"))
    df = spark.createDataFrame([(*f, "x") for f in files], "root string, path string, folder string")
    got = {(r["root"], r["path"]) for r in ignore_table.ignored_paths(df, table).collect()}
    assert got == want and len(want) > 20
    left = ignore_table.not_ignored(df, table)
    assert left.columns == df.columns and left.count() == len(files) - len(want)
    # the same as the pattern of one root at plan time
    own = [g for r, g in rules if r == "r1"]
    one = spark.createDataFrame([(p,) for p in PATHS], "path string").filter(selection.is_ignored(F.col("path"), own))
    assert {r["path"] for r in one.collect()} == {p for r, p in got if r == "r1"}
    assert ignore_table.not_ignored(df, table.limit(0)).count() == len(files)


def test_literal_folder():
    cases = {"docs/*.md": "docs", "a/b/c": "a/b", "/a/b/c": "a/b", "**/x": "", "a/**/b": "a", "a/{b,c}/d": "a", "x": "", "a\\*/b": ""}
    assert {g: ignore_table.literal_folder(g) for g in cases} == cases


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_versions_write_what_changed(spark, tmp_path):
    rows = [(f"d/f{i:03d}.py", "python", "".join(f"x{i}_{n} = {n}\n" for n in range(200)) + ("print(1)\n" if i % 50 == 0 else "")) for i in range(200)]
    base = str(tmp_path / "base")
    spark.createDataFrame(rows, "path string, language string, content string").write.parquet(base)
    corpus = CorpusVersions(spark, str(tmp_path / "corpus"), base)
    assert corpus.version == 0 and corpus.read().count() == 200
    assert corpus.fix() == 1
    texts = {r["path"]: r["content"] for r in corpus.read().collect()}
    assert texts == {p: t.replace("print(1)\n", "") for p, _, t in rows}
    assert size_of(tmp_path / "corpus") < size_of(base) / 10
    # a second version on top, with a new file and one that was changed before; older versions stay as they were
    corpus.commit(spark.createDataFrame([(rows[0][0], "python", "new"), ("added.py", "python", "more")], "path string, language string, content string"))
    again = CorpusVersions(spark, str(tmp_path / "corpus"))
    texts |= {rows[0][0]: "new", "added.py": "more"}
    assert {r["path"]: r["content"] for r in again.read().collect()} == texts
    assert {r["path"]: r["content"] for r in again.read(0).collect()} == {p: t for p, _, t in rows}
    assert again.read(1).count() == 200 and again.read(2).count() == 201
    with pytest.raises(ValueError):
        CorpusVersions(spark, str(tmp_path / "corpus"), "elsewhere")
    with pytest.raises(FileNotFoundError):
        CorpusVersions(spark, str(tmp_path / "none"))
