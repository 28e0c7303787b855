import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lineweave.plans import incremental
from lineweave.plans.policies import policy_named
from lineweave.plans.review import ReviewOptions, review_files
from lineweave.streaming.ingest import (
    FILES_SCHEMA, current_entries, current_findings, rescan, review_batch, start_reviews, with_texts,
)
from lineweave.streaming.store import FANOUT, ReviewStore
from querybook import queries

OPTIONS = ReviewOptions(rule_set="scan")
DAY = datetime.datetime(2024, 1, 1)


def corpus(spark, texts, modified=DAY):
    rows = [(path, len(text), modified, text) for path, text in texts.items()]
    return spark.createDataFrame(rows, FILES_SCHEMA)


def scan(files, version, policy="quick"):
    entries = review_files(incremental.with_fingerprint(files), policy_named(policy), OPTIONS)
    return incremental.entries_to_store(entries, version)


def test_rescan_equals_full_scan(spark, tmp_path):
    version = incremental.ruleset_version("quick", "scan")
    old = {f"f{i}.py": f"secret {i}" for i in range(20)}
    scan(corpus(spark, old), version).write.parquet(str(tmp_path / "v1"))
    store = spark.read.parquet(str(tmp_path / "v1"))
    new = {k: ("unsafe now" if i % 5 == 0 else t) for i, (k, t) in enumerate(old.items()) if i != 19}
    new["added.py"] = "TODO"
    files = incremental.with_fingerprint(corpus(spark, new))
    changed = incremental.misses(files, store, version)
    assert sorted(r["path"] for r in changed.collect()) == ["added.py", "f0.py", "f10.py", "f15.py", "f5.py"]
    kept = incremental.hits(files, store, version)
    assert kept.count() == 15
    fresh = scan(changed.drop("content_hash"), version)
    merged = incremental.upsert(store, fresh, version)
    full = scan(corpus(spark, new), version)
    current = merged.filter("path <> 'f19.py'")          # deleted files stay in the store
    assert sorted(map(str, current.collect())) == sorted(map(str, full.collect()))
    assert merged.count() == 21


def test_other_versions_and_times_are_not_reused(spark):
    version = incremental.ruleset_version("quick", "scan")
    store = scan(corpus(spark, {"a.py": "x"}), version)
    same = incremental.with_fingerprint(corpus(spark, {"a.py": "x"}))
    assert incremental.missed_keys(same, store, version).count() == 0
    assert incremental.missed_keys(same, store, incremental.ruleset_version("strict", "scan")).count() == 1
    later = incremental.with_fingerprint(corpus(spark, {"a.py": "x"}, DAY + datetime.timedelta(days=1)))
    assert incremental.missed_keys(later, store, version).count() == 1
    assert incremental.upsert(store, store.limit(0), "other").count() == 0


def test_an_edit_far_behind_is_a_miss(spark):
    df = corpus(spark, {"a": "x" * 4096 + "1", "b": "x" * 4096 + "2"})
    assert len({r["content_hash"] for r in incremental.with_fingerprint(df).collect()}) == 2
    assert len({r["content_hash"] for r in incremental.with_fingerprint(df, 4096).collect()}) == 1


def test_rescan_reviews_changes_only(spark, tmp_path):
    policy, texts = policy_named("quick"), {f"f{i}.py": "x" * 5000 + f" secret {i}" for i in range(6)}
    first = incremental.rescan(corpus(spark, texts), spark.createDataFrame([], incremental.store_schema()), policy, OPTIONS)
    first.write.parquet(str(tmp_path / "v1"))
    marked = spark.read.parquet(str(tmp_path / "v1")).withColumn("content_preview", F.lit("old"))
    texts["f2.py"] = "x" * 5000 + " unsafe 2"
    now = {r["path"]: r for r in incremental.rescan(corpus(spark, texts), marked, policy, OPTIONS).collect()}
    assert {p for p, r in now.items() if r["content_preview"] is None} == {"f2.py"} and len(now) == 6
    assert [f["rule"] for f in now["f2.py"]["findings"]] == ["unsafe-usage"]
    other = incremental.ruleset_version(replace(policy, severity_threshold="high"), "scan", options=OPTIONS)
    assert other != incremental.ruleset_version(policy, "scan", options=OPTIONS)


def rules(entries):
    return {r["path"]: [f["rule"] for f in r["findings"]] for r in entries.collect()}


def test_stream_reviews_only_what_changed(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    policy = policy_named("quick")

    def run():
        start_reviews(spark, source, target, checkpoint, policy, OPTIONS).awaitTermination()

    corpus(spark, {"a.py": "secret", "b.py": "unsafe"}).coalesce(1).write.parquet(source)
    run()
    corpus(spark, {"a.py": "secret", "b.py": "plain", "c.py": "TODO"}).coalesce(1).write.mode("append").parquet(source)
    run()
    store = ReviewStore(spark, f"{target}/store")
    names = [s.name for s in store.segments]
    log = sorted((r["path"], r["seq"]) for r in store.entries().collect())
    assert log == [("a.py", 1), ("b.py", 1), ("b.py", 2), ("c.py", 2)]
    assert rules(current_entries(spark, target)) == {"a.py": ["possible-secret"], "b.py": [], "c.py": ["todo-comment"]}
    # a batch that runs again leaves the same result; a new checkpoint starts at batch 0 and replaces nothing
    again = corpus(spark, {"a.py": "secret", "b.py": "plain", "c.py": "TODO"})
    review_batch(again, 1, target, policy, OPTIONS, names[1].split("-")[0])
    assert current_entries(spark, target).count() == 3 and current_findings(spark, target).count() == 2
    assert ReviewStore(spark, f"{target}/store").entries().count() == 4
    other = corpus(spark, {"a.py": "secret", "d.py": "unsafe"}).unionByName(
        corpus(spark, {"d.py": "newer TODO"}, DAY + datetime.timedelta(days=1)))
    store = review_batch(other, 0, target, policy, OPTIONS, "another")
    assert rules(store.entries().filter(f"seq = {store.version}")) == {"d.py": ["todo-comment"]}


def test_reads_do_not_grow_with_batches(spark, tmp_path):
    policy, texts, opened = policy_named("quick"), {f"f{i}.py": f"x {i}" for i in range(12)}, []
    for n in range(20):
        texts = {p: (f"unsafe {n}" if i == n % 12 else t) for i, (p, t) in enumerate(texts.items())}
        store = review_batch(corpus(spark, texts), n, str(tmp_path), policy, OPTIONS)
        opened.append(len(store.segments))
    # twelve paths are two size classes: the first scan's, and that of single files
    assert max(opened) <= 2 * FANOUT and max(opened[10:]) <= max(opened[:10]) + 1, opened
    now = {r["path"]: r["content_hash"] for r in store.current().collect()}
    assert now == {r["path"]: r["content_hash"] for r in incremental.with_fingerprint(corpus(spark, texts)).collect()}
    assert store.entries().count() < 12 + 19 and sum(s.rows for s in store.segments) == store.entries().count()
    # merged segments can go; what is live stays, and a store that is opened anew is the same
    assert store.vacuum() and not store.vacuum()
    assert sorted(map(str, ReviewStore(spark, store.path).current().collect())) == sorted(map(str, store.current().collect()))


def test_arrivals_are_written_by_many_tasks_and_reviewed_in_one_batch_each(spark, tmp_path, monkeypatch):
    (spark.range(400).selectExpr("id AS doc_id", "concat('secret ', id) AS text", "'s' AS source")
     .repartition(6).write.parquet(str(tmp_path / "documents.parquet")))
    arrived, batches = [], []

    def counted(session, source, target, *args, **options):
        files = session.read.parquet(source).groupBy(F.input_file_name()).count().collect()
        arrived.append([r["count"] for r in files])
        query = start_reviews(session, source, target, *args, **options)
        query.awaitTermination()
        batches.append(len(ReviewStore(session, f"{target}/store").segments))
        return query

    monkeypatch.setattr(queries, "ARRIVALS", 2)
    monkeypatch.setattr(queries, "start_reviews", counted)
    got = queries.stream_compaction(spark, str(tmp_path)).collect()
    assert {r["path"] for r in got} == {f"doc/{i:012d}" for i in range(400)} and {r["rules"] for r in got} == {"possible-secret"}
    assert [sum(rows) for rows in arrived] == [200, 400] and batches == [1, 2]
    assert all(len(rows) > 4 and max(rows) < 100 for rows in arrived)


def later(texts, modified, changed, when=DAY + datetime.timedelta(days=1)):
    """A later scan: times of the changed paths move on."""
    return [(p, len(t), when if p in changed else modified, t) for p, t in texts.items()]


def test_rescan_of_a_store_reads_changed_texts_only(spark, tmp_path):
    policy, store = policy_named("quick"), ReviewStore(spark, str(tmp_path / "store"), buckets=4)
    texts = {f"f{i}.py": f"secret {i:03d}" for i in range(400)}
    assert rescan(corpus(spark, texts), store, policy, OPTIONS) == 400
    assert rescan(corpus(spark, texts), store, policy, OPTIONS) == 0
    texts |= {"f7.py": "unsafe 007", "f9.py": "secret 9", "new.py": "TODO"}
    rows = later(texts, DAY, {"f7.py", "new.py"})
    rows[3] = (*rows[3][:3], "hidden 003")  # same size, same time: not looked at when times are trusted
    assert rescan(spark.createDataFrame(rows, FILES_SCHEMA), store, policy, OPTIONS) == 3
    now = rules(store.current())
    assert len(now) == 401 and now["f7.py"] == ["unsafe-usage"] and now["new.py"] == ["todo-comment"] and now["f3.py"] == ["possible-secret"]
    assert rescan(spark.createDataFrame(rows, FILES_SCHEMA), store, policy, OPTIONS, trust_times=False) == 1
    assert rules(store.current())["f3.py"] == []
    # files without a time are never trusted
    unknown = spark.createDataFrame([(p, s, None, t) for p, s, _, t in rows], FILES_SCHEMA)
    assert rescan(unknown, store, policy, OPTIONS) == 401


def test_a_rescan_does_not_shuffle_the_store(spark, tmp_path):
    policy, store = policy_named("quick"), ReviewStore(spark, str(tmp_path / "store"), buckets=4)
    texts = {f"f{i}.py": f"x {i}" for i in range(50)}
    rescan(corpus(spark, texts), store, policy, OPTIONS)
    rescan(spark.createDataFrame(later(texts, DAY, {"f1.py", "f2.py"}), FILES_SCHEMA), store, policy, OPTIONS)
    assert len(store.segments) == 2
    listing = corpus(spark, texts).select("path", "size", "modified").hint("shuffle_merge")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compared = store.compared(listing)
        plan = compared._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2 and plan.count("SortMergeJoin") == 2, plan
        newest = {r["path"]: r["known"]["seq"] for r in compared.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert newest == {p: 2 if p in ("f1.py", "f2.py") else 1 for p in texts}


def test_names_go_through_a_bitmap(spark):
    files = corpus(spark, {f"p{i}": str(i) for i in range(3000)})
    names = files.filter("content % 30 = 0").select("path")
    found = with_texts(files, names, 100, bitmap_from=1)
    assert sorted(int(r["content"]) for r in found.collect()) == list(range(0, 3000, 30))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and files.columns == found.columns


def test_a_writer_that_fails_leaves_the_last_state(spark, tmp_path):
    policy = policy_named("quick")
    store = review_batch(corpus(spark, {"a.py": "secret"}), 0, str(tmp_path), policy, OPTIONS)
    late = ReviewStore(spark, store.path)
    review_batch(corpus(spark, {"b.py": "TODO"}), 1, str(tmp_path), policy, OPTIONS)
    with pytest.raises(FileExistsError):  # a second writer does not overwrite a manifest
        late._commit(())
    # entries without a manifest that names them do not count, and a batch that runs again replaces them
    broken = ReviewStore(spark, store.path)
    broken._write(broken.entries(), "r0-000000002")
    assert current_entries(spark, str(tmp_path)).count() == 2
    review_batch(corpus(spark, {"c.py": "x"}), 2, str(tmp_path), policy, OPTIONS)
    assert sorted(rules(current_entries(spark, str(tmp_path)))) == ["a.py", "b.py", "c.py"]


def test_a_broken_store_is_an_error(spark, tmp_path):
    policy = policy_named("quick")
    store = review_batch(corpus(spark, {"a.py": "x"}), 0, str(tmp_path), policy, OPTIONS)
    for part in (tmp_path / "store" / "segments").glob("*/*.parquet"):
        part.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        store.current().collect()


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from lineweave.session import checkpointed
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    assert checkpointed(spark.range(3)).count() == 3
    assert list((tmp_path / "shared").iterdir())
