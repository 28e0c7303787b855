import random
import re

from pyspark.sql import functions as F

from lineweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k:k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(d, b, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr)


def cases():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "éa", "a1", "b", "zz", "É", "q"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, "The OF b"), (4, ""), (5, None), (6, "!!"), (10, "the of B."), (7, "the the the"), (8, "nowhere at all")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(30)]
    docs += [(50, items[0][1].upper() + " " + text(5) + " " + items[1][1]), (51, None), (52, ""), (53, "the " * 50), (None, "the of b"),
             (54, items[1][1]), (54, items[1][1]), (54, "the of b"), (55, "É the ÉA of")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items, 13)


def test_large_benchmarks_take_the_shuffled_join(spark):
    docs, items = cases()
    assert run(spark, docs, items, small_windows=0) == brute(docs, items, 13)
    assert run(spark, docs, items, small_windows=0, most_words=0) == brute(docs, items, 13)


def test_drop_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, "something else"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()) == [2, 3]
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 3
    assert decontaminate.contamination(d.limit(0), b).count() == 0
