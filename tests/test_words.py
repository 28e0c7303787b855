import random
import re

import pytest
from pyspark.sql import functions as F

from lineweave.functions.words import WordSet, trie_pattern
from lineweave.plans.policies import POLICIES
from lineweave.sources import selection


def test_pattern_takes_the_longest():
    words = ["token", "token=", "tok", "key", "api_key", "a.b", "(x", "é"]
    pattern = re.compile(trie_pattern(words))
    for text, longest in (("token=1", "token="), ("tokens", "token"), ("to tok", None), ("a.b", "a.b"), ("axb", None), ("(x)", "(x"), ("é", "é")):
        found = pattern.match(text)
        assert (found.group() if found else None) == longest


@pytest.mark.parametrize("seed", [1, 2])
def test_found_words_are_all_that_occur(spark, seed):
    rng = random.Random(seed)
    make = lambda low, high: "".join(rng.choice("ab(.") for _ in range(rng.randint(low, high)))
    words = sorted({make(1, 4) for _ in range(30)})
    groups = [rng.sample(words, 3) for _ in range(5)]
    texts = [make(0, 25) for _ in range(200)] + [None, ""]
    known = WordSet(words)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", known.found(F.col("t")))
    got = df.select("t", *[F.coalesce(known.holds_any(F.col("f"), g), F.lit(False)).alias(f"g{i}") for i, g in enumerate(groups)]).collect()
    for row in got:
        assert [row[f"g{i}"] for i in range(5)] == [any(w in (row["t"] or "") for w in g) for g in groups], row


def test_gates_are_those_of_each_policy(spark):
    rng = random.Random(4)
    pool = [p for policy in POLICIES for p in policy.suspicious_patterns] + ["Toke", "n=", "plain", "api", "_KEY", "password"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    single = [selection.is_suspicious(F.col("t"), p.suspicious_patterns).alias(p.name) for p in POLICIES]
    for row in df.select(selection.gates(F.col("t"), POLICIES).alias("gates"), *single).collect():
        assert row["gates"] == [p.name for p in POLICIES if row[p.name]]
    assert WordSet([]).pattern is None
