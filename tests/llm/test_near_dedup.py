import random

import numpy as np
import pyarrow as pa

from lineweave.llm import near_dedup
from lineweave.llm import wordhash as wh
from lineweave.llm.linking import components, link_to_leaders


def shingles(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """Class ids by all pairs."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    nodes = sorted((min(ids), t) for t, ids in texts.items())
    parent = {n: n for n, _ in nodes}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, ta in nodes:
        for b, tb in nodes:
            sa, sb = shingles(ta), shingles(tb)
            if a < b and sa and sb and len(sa & sb) >= 0.8 * len(sa | sb):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(min(ids)) for t, ids in texts.items() for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 300]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def test_classes_against_all_pairs(docs):
    rows = corpus() + [(900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "..."), (905, "x " * 4000), (906, "x " * 4000),
                       (906, "x " * 4000)]
    got = near_dedup.near_groups(docs(*rows)).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_a_text_that_only_repeats_a_phrase_is_not_a_copy(docs):
    phrase = "very common words here again " * 60
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(60)) + " " + phrase) for i in range(12)]
    assert all(r["kept"] for r in near_dedup.near_groups(docs(*rows)).collect())


def test_close_pairs_in_a_large_template_group(spark, docs):
    rng = random.Random(9)
    letter = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(0, 240, 2):  # letters are less than 0.8 alike, but for the pairs with one edit
        own = list(letter)
        for k in rng.sample(range(5, 295, 10), 8):
            own[k] = f"own{i}x{k}"
        close = list(own)
        if i % 40 == 0:
            close[150] = f"edit{i}"
        else:
            for k in rng.sample(range(2, 298, 9), 8):
                close[k] = f"own{i + 1}x{k}"
        rows += [(i, " ".join(own)), (i + 1, " ".join(close))]
    got = near_dedup.near_groups(docs(*rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)


def test_a_template_group_is_compared_in_proportion(docs, monkeypatch):
    """A thousand letters with one template, less than 0.8 alike, among them close pairs: pairs compared are about as many."""
    rng = random.Random(11)
    letter, rows = [f"t{i}" for i in range(200)], []
    for i in range(1000):
        own = letter[:120] + [f"own{i}x{k}" for k in range(80)]
        if i % 100 == 1:
            own = rows[-1][1].split()
            own[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    compared, real = [], near_dedup.prefix_pairs

    def counted(*args):
        pairs = real(*args)
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "prefix_pairs", counted)
    # bands of two coordinates put nearly all of them into a few groups
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs(*rows), rows=2, bands=60).collect()}
    assert got == {i: i - (i % 100 == 1) for i in range(1000)}
    assert compared and compared[0] < 200


def test_prefix_pairs_lose_nothing(docs, spark):
    """All pairs of random sets that are similar enough are among the candidates, whatever the frequencies are."""
    rng = random.Random(12)
    bases = [[rng.choice([f"c{k}" for k in range(30)] + [f"r{k}" for k in range(3000)]) for _ in range(rng.choice([5, 20, 80]))] for _ in range(30)]
    texts = []
    for n in range(150):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(50)}"
        texts.append(" ".join(own))
    bodies = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    for cls in (lambda i: i, lambda i: i % 3):
        open_ = spark.createDataFrame([(i, cls(i)) for i in range(150)], "id bigint, cls bigint")
        got = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(open_, bodies).collect()}
        sets = [shingles(t) for t in texts]
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if cls(i) != cls(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert want <= got and want and all(cls(i) != cls(j) and i < j for i, j in got)


def test_leaders_link_and_the_rest_stays_open(spark):
    members = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0), (2, 9)], "key bigint, id bigint")
    links, open_ = link_to_leaders(members, lambda pairs: pairs.filter("b < 4 or b = 9"))
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(0, 1), (0, 2), (0, 3), (0, 9)]
    assert sorted((r["id"], r["cls"]) for r in open_.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5)]


def test_null_ids_keep_one_and_empty_table(docs):
    long = " ".join(f"a{i}" for i in range(100))
    rows = [(None, long), (5, long), (6, long + " end"), (None, "other text"), (7, None), (8, "")]
    df = docs(*rows)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "other text"), (5, long), (7, "")]
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    heavy = np.concatenate([a[:200], np.repeat(a[:20], 20)])
    b = np.concatenate([a[:300], rng.integers(0, 2 ** 63, 100).astype(np.uint64)])
    sets = np.concatenate([a, b, heavy, a[:1]])
    start = np.array([0, 400, 800, 800 + len(heavy), 801 + len(heavy)])
    cell, text = near_dedup.cells(sets, start, max_weight=100)
    s = near_dedup.dart_signatures(cell, text, 4, 4096)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.04
    assert abs((s[0] == s[2]).mean() - 200 / (600 + 400 - 200)) < 0.04
    assert (s != 0).all()


def test_signatures_do_not_depend_on_neighbours():
    texts = ["a b c d e f g", "", "x", "the quick brown fox jumps over the lazy dog " * 30]
    def sign(some):
        hashes, _, _, first = wh.words(*wh.text_buffers(pa.array(some)))
        cell, text = near_dedup.cells(*wh.shingles(hashes, first, 5))
        return near_dedup.dart_signatures(cell, text, len(some), 64)
    together = sign(texts)
    assert all((sign([t])[0] == together[i]).all() for i, t in enumerate(texts))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["class_id"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
