import importlib
import os
import subprocess
import sys

import corpus_pipeline
from lineweave.llm import decontaminate, near_dedup
from lineweave.session import stored

SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, SF), name)
        assert rows.columns == docs.columns, name
    kept = {r["doc_id"]: r for r in rows.collect()}
    # what is left has no near duplicates and no contaminated documents, and texts and counts agree
    assert all(r["kept"] for r in near_dedup.near_groups(rows).collect())
    found = decontaminate.contamination(rows, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert not any(r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"] for r in found)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    packed = corpus_pipeline.packing_stage(spark, rows, SF).collect()
    joined = {}
    for r in sorted(packed, key=lambda r: r["segment"]):
        joined[r["doc_id"]] = joined.get(r["doc_id"], "") + r["segment_text"]
    assert joined == {i: r["text"] for i, r in kept.items() if r["text"]}


def test_the_library_does_not_need_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "lineweave", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "lineweave").mkdir()
    for name in os.listdir(f"{root}/lineweave"):
        if name != "llm":
            os.symlink(f"{root}/lineweave/{name}", tmp_path / "lineweave" / name)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.startswith("[] ") and int(out.stdout.split()[-1]) > 50


def test_registered_names():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
