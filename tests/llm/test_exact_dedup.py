import hashlib

from pyspark.sql import functions as F

from lineweave.llm import exact_dedup

LONG = "abc. " * 3000


def groups(df, **options):
    return {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(df, **options).collect()}


def test_groups_nulls_empties_long_texts(docs):
    rows = [(1, "a\nb"), (2, "a\nb"), (3, "a\nb "), (4, None), (5, ""), (6, LONG), (7, LONG), (8, LONG + "x")]
    got = {k[0]: v for k, v in groups(docs(*rows)).items()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (7, 2, False), 7: (7, 2, True),
        8: (8, 1, True)}
    assert got[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_a_bad_fingerprint_changes_nothing(docs):
    rows = [(i, t) for i, t in enumerate(["one", "two", "six", "one", LONG, LONG.replace("abc", "abd", 1), LONG])]
    good, bad = groups(docs(*rows)), groups(docs(*rows), fingerprint=lambda c: F.length(c))
    assert {k: (r["keep_id"], r["group_size"]) for k, r in good.items()} == {k: (r["keep_id"], r["group_size"]) for k, r in bad.items()}


def test_chunks_join_to_the_text(docs):
    texts = ["", "x", LONG, "é\n" * 500, "a" * 10000, "line one.\nline two!\n\nend"]
    df = docs(*enumerate(texts)).select("text", F.array_join(exact_dedup.chunks_of(F.col("text")), "").alias("again"))
    assert all(r["text"] == r["again"] for r in df.collect())


def test_null_ids_repeated_rows_and_empty_table(docs):
    got = exact_dedup.exact_groups(docs((None, "t"), (3, "t"), (3, "t"), (None, "alone"))).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 1, True), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]
    assert exact_dedup.exact_groups(docs().limit(0)).count() == 0
    assert exact_dedup.dedup(docs((1, "a"), (2, "a"))).columns == ["doc_id", "text", "source", "kept"]
