import random
from collections import Counter

import numpy as np
import pytest

from lineweave.llm import suffix_dedup


def brute(texts, length):
    """Removed bytes of each text from the definition: every window of every text is counted."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans, kept = [], bytes(b for b, g in zip(d, gone) if not g)
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append([i, i])
            if g:
                spans[-1][1] = i + 1
        out.append((len(d), [tuple(s) for s in spans], kept))
    return out


def found(spark, texts, length, parts=5):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id int, text string, kept string, item int")
    got = suffix_dedup.remove_repeats(df.repartition(parts), length=length).collect()
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got}
    return [got[i] for i in range(len(texts))]


def made_texts(seed, length):
    """Texts of passages, of all lengths about the limit, with changes, copies, periods and few letters."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdeé ") for _ in range(k))
    passages = [word(rnd.choice([length - 1, length, length + 1, length + 7, 2 * length, 3 * length])) for _ in range(12)]
    texts = [None, "", "a" * (length - 1), "a" * length, "a" * (length + 1), "ab" * length, "ab" * (2 * length) + "c"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                at = rnd.randrange(len(p))
                p = p[:at] + rnd.choice(["X", "", "YZ"]) + p[at + 1:]
            parts += [p, word(rnd.choice([0, 1, 5, length]))]
        texts.append("".join(parts))
    return texts + texts[-5:] + [passages[0]] * 30


@pytest.mark.parametrize("length,seed", [(20, 1), (33, 2), (200, 3), (200, 4)])
def test_against_all_windows(spark, length, seed):
    texts = made_texts(seed, length)
    assert found(spark, texts, length) == brute(texts, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    rnd = random.Random(7)
    common = "".join(rnd.choice("abcdefgh") for _ in range(700))
    long = ["".join(rnd.choice("abcdefgh") for _ in range(5000)) for _ in range(4)]
    texts = [long[0] + common + long[1], long[2] + common[:350] + "#" + common[350:] + long[3], long[1][1000:1800], "z" * 3000]
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 40)
    monkeypatch.setattr(suffix_dedup, "BATCH", 7)
    assert found(spark, texts, 200) == brute(texts, 200)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(None, "q" * 300), (1, None), (1, "r" * 150)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], len(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(0, 300, 0), (1, 0, 0), (1, 150, 150)]


def test_a_hot_passage_costs_a_row_a_task():
    """Entries of one passage in many texts meet inside the family: levels stay small and logarithmic in number."""
    family, rng = suffix_dedup.Family(), np.random.default_rng(1)
    hot = rng.integers(0, 1 << 63, (2, 10), dtype=np.uint64)
    for i in range(200):
        own = rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
        s, t = np.concatenate((hot, own), axis=1)
        family.add(s, t, np.full(60, i), np.arange(60), np.ones(60, np.int64))
    assert len(family) == 200 * 50 + 10 and len(family.levels) <= 14
    reported = {(a, b) for x, y in family.repeats for a, b in zip(x.tolist(), y.tolist())}
    assert reported == {(i, j) for i in range(200) for j in range(10)}
