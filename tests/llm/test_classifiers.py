import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lineweave.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out_rows(spark, name, label):
    found = queries.QUERIES[name](spark, SF)
    return found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("doc_id", "held_out", "score", "predicted", label).collect()


def test_quality_of_documents_that_it_has_not_seen(spark):
    rows = held_out_rows(spark, "op8_quality", "quality")
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    seen = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in seen]) >= 0.85


def test_toxicity_of_documents_that_it_has_not_seen(spark):
    rows = held_out_rows(spark, "op6_toxicity", "toxic")
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    seen = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert np.mean([r["predicted"] == r["toxic"] for r in seen]) >= 0.9
    both = sum(r["predicted"] and r["toxic"] for r in seen)  # always 0 would be right for most
    assert both >= 0.75 * sum(r["toxic"] for r in seen) and both >= 0.9 * sum(r["predicted"] for r in seen)


def test_first_rows_by_key_are_those_of_a_sort(spark):
    rng = np.random.default_rng(9)
    for keys in (rng.integers(0, 2 ** 64, 3000, dtype=np.uint64), rng.integers(0, 2 ** 20, 3000, dtype=np.uint64), np.full(500, 7, np.uint64)):
        rows = [(int(k), bytes([i % 251])) for i, k in enumerate(keys.view(np.int64))]
        df = spark.createDataFrame(rows, "key bigint, x binary")
        want = sorted((k % 2 ** 64, x) for k, x in rows)
        for n in (1, 100, 5000):
            assert [(r["key"] % 2 ** 64, bytes(r["x"])) for r in toxicity.first_by_key(df, n)] == want[:n]


def brute_marginals(score, transition):
    """By all labellings of one chain."""
    n, total, inside = len(score), 0.0, np.zeros(len(score))
    for bits in range(2 ** n):
        y = [bits >> i & 1 for i in range(n)]
        weight = math.exp(sum(s for s, k in zip(score, y) if k) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        total += weight
        inside += weight * np.array(y)
    return inside / total, math.log(total)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    lengths, transition = [1, 5, 3, 5, 8], rng.normal(size=(2, 2))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    score = rng.normal(size=len(chain)) * 2
    marginal, _, logs = toxicity.forward_backward(score, chain, transition)
    want = [brute_marginals(score[chain == c], transition) for c in range(len(lengths))]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.isclose(logs, sum(w[1] for w in want))


def test_spans_offsets_and_odd_rows(docs, spark):
    toxic = ["idiot", "moron"]
    rows = [(i, f"été {'w%d' % (i % 17)} {toxic[i % 2] if i % 3 == 0 else 'friend'} of v{i} and x{i % 5} more words here.") for i in range(150)]
    rows += [(900, None), (901, ""), (902, "ça! You idiot."), (903, "!!"), (904, "calm " * 3000), (902, "fine words"), (None, "idiot here")]
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(900, None), (None, 1)], "id bigint, label int")
    got = toxicity.toxic_spans(docs(*rows), known).collect()
    assert len(got) == len(rows)
    spans = {r["doc_id"]: r for r in got if r["doc_id"] in (900, 901, 903, 904)}
    assert all(r["score"] < 0.5 and not r["spans"] for r in spans.values())
    text = "ça! You idiot."
    hit = [r for r in got if r["doc_id"] == 902 and r["spans"]]
    assert len(hit) == 1 and [text[s["begin"]:s["end"]] for s in hit[0]["spans"]] == ["idiot"] and hit[0]["score"] > 0.5
    assert all(r["score"] < 1e-6 for r in toxicity.toxic_spans(docs(*rows), known.limit(0)).collect())
    assert toxicity.toxic_spans(docs(*rows).limit(0), known).count() == 0


def test_quality_odd_rows_and_columns(docs, spark):
    rows = [(i, ("### *** " * 20) if i % 2 else f"plain words number {i} in a row") for i in range(60)]
    rows += [(900, None), (901, ""), (902, "word " * 20000), (3, "other text"), (None, "x")]
    known = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(900, None), (3, 0), (3, 0)], "id bigint, label int")
    df = docs(*rows).withColumn("score", F.lit("clash"))
    got = quality.score(df, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i in range(60) if i % 2 == 0} <= ids and not ids & {i for i in range(5, 60) if i % 2}
    assert all(r["score"] == 0.5 for r in quality.score(df, known.limit(0)).collect())
    assert quality.score(df.limit(0), known).count() == 0
