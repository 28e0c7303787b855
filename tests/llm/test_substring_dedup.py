import random

import numpy as np

from lineweave.llm import linking, substring_dedup as sd
from lineweave.llm.linking import link_by_leaders


def test_compact_windows_are_those_of_the_definition():
    rng = np.random.default_rng(3)
    for n, least in ((0, 3), (2, 3), (40, 3), (60, 7), (60, 1)):
        h = rng.integers(1, 30, n).astype(np.uint64)  # with ties
        want = set()
        for c in range(n):
            low = c
            while low > 0 and h[low - 1] > h[c]:
                low -= 1
            high = c
            while high < n - 1 and h[high + 1] >= h[c]:
                high += 1
            if high - low + 1 >= least:
                want.add((low, c, high))
        assert {tuple(map(int, w)) for w in sd.compact_windows(h, np.array([0, n]), least)[:, :3]} == want
        two = np.concatenate((h, h[:n // 2]))
        both = sd.compact_windows(two, np.array([0, n, n, len(two)]), least)[:, :3].tolist()
        second = sd.compact_windows(h[:n // 2], np.array([0, n // 2]), least)[:, :3] + n
        assert sorted(map(tuple, both)) == sorted([*want, *map(tuple, second.tolist())])


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    shared = [words(rng, 70) for _ in range(4)]
    rows = []
    for i in range(40):
        body = words(rng, rng.randint(30, 200))
        if i % 2 == 0:
            passage = list(shared[i % 4 + (i % 8 == 0)])
            if i % 6 == 0:
                passage[35] = "edited"
            at = rng.randrange(len(body))
            body[at:at] = passage
        rows.append((i, " ".join(body)))
    return rows


def test_shared_passages_are_found_and_placed(docs):
    rows = corpus()
    rows += [(100, rows[1][1]), (101, None), (102, ""), (103, "short text"), (104, "short text"), (None, rows[0][1]), (0, rows[0][1]),
             (105, "same words again " * 3000)]
    got = sd.repeated_passages(docs(*rows)).collect()
    texts = dict(r for r in rows if r[0] is not None)
    by_class = {}
    for r in got:
        part = texts[r["doc_id"]].split()[r["start_word"]:r["end_word"]]
        assert len(part) >= sd.MIN_WORDS
        by_class.setdefault(r["class_id"], []).append((r["doc_id"], r["kind"], part))
    assert {r["doc_id"] for r in got if r["kind"] == "passage"} == {i for i in range(40) if i % 2 == 0}
    assert {r["doc_id"] for r in got if r["kind"] == "text"} == {1, 100}
    for members in by_class.values():
        first = set(members[0][2])
        assert len({m[0] for m in members}) > 1 and all(len(first & set(m[2])) > 40 for m in members)
    # documents with one passage are in one class
    base = {i: i % 4 + (i % 8 == 0) for i in range(0, 40, 2)}
    classes = {r["doc_id"]: r["class_id"] for r in got if r["kind"] == "passage"}
    assert all((classes[a] == classes[b]) == (base[a] == base[b]) for a in base for b in base)
    assert all(r["class_doc"] == min(m[0] for m in by_class[r["class_id"]]) and r["n_docs"] == len({m[0] for m in by_class[r["class_id"]]})
               for r in got)


def test_verification_finds_edited_passages():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2 ** 62, 300).astype(np.uint64), rng.integers(0, 2 ** 62, 300).astype(np.uint64)
    b[100:200] = a[50:150]
    b[140:145] = rng.integers(0, 2 ** 62, 5).astype(np.uint64)
    assert [x[:4] for x in sd.similar_passages(a, b)] == [(50, 150, 100, 200)]
    assert sd.similar_passages(a, b[:120]) == []


def test_every_place_of_a_passage_is_paired_in_both_orders():
    rng = np.random.default_rng(6)
    def fresh(n):
        return rng.integers(0, 2 ** 62, n).astype(np.uint64)
    one, two = fresh(96), fresh(96)
    beside = np.concatenate([fresh(40), one, fresh(4), two, fresh(40)])
    apart = np.concatenate([fresh(20), one, fresh(300), two, fresh(20)])
    want = {(40, 136, 20, 116), (140, 236, 416, 512)}
    assert {x[:4] for x in sd.similar_passages(beside, apart)} == want
    assert {(*x[2:4], *x[:2]) for x in sd.similar_passages(apart, beside)} == want
    twice = np.concatenate([one, fresh(300), one])
    assert {x[2:4] for x in sd.similar_passages(beside, twice)} == {(0, 96), (396, 492)}
    # a stretch of each list holds more than the passage
    mixed = np.concatenate([one, fresh(200), two, one])
    swapped = np.concatenate([two, fresh(200), one])
    assert {x[:4] for x in sd.similar_passages(mixed, swapped)} == {(0, 96, 296, 392), (392, 488, 296, 392), (296, 392, 0, 96)}


def test_late_members_of_a_group_meet(spark):
    # members 20 and 31 alone are alike in a group whose other members are not
    members = spark.createDataFrame([(7, i) for i in range(40)], "key bigint, id bigint")
    links = link_by_leaders(members, lambda pairs: pairs.filter("a = 20 and b = 31"))
    assert [(r["a"], r["b"]) for r in links.collect()] == [(20, 31)]


def test_ranges_merge_to_their_union():
    rng = np.random.default_rng(8)
    for _ in range(50):
        ranges = np.sort(rng.integers(0, 60, (rng.integers(0, 8), 2)), axis=1) + [0, 1]
        got = sd.merged(ranges)
        covered = {x for b, e in ranges for x in range(b, e)}
        assert [x for b, e in got for x in range(b, e)] == sorted(covered)


def test_joined_windows_hold_all_passages_of_two_shared_minima():
    rng = np.random.default_rng(10)
    for least, n, kinds in ((3, 30, 5), (6, 60, 40), (4, 40, 2)):
        for _ in range(20):
            hs = [rng.integers(1, kinds + 1, n).astype(np.uint64) for _ in range(3)]
            known = np.unique(rng.integers(1, kinds + 1, max(1, kinds // 2))).astype(np.uint64)
            windows = []
            for h in hs:
                w = sd.compact_windows(h, np.array([0, n]), least)
                windows.append(sd.chains(w[np.isin(h[w[:, 1]], known)]))
            got = sd.merged(sd.joined_windows(windows, least))
            for b in range(n):
                for e in range(b + least, n + 1):
                    if sum(h[b:e].min() in known for h in hs) > 1:
                        assert any(x <= b and e <= y for x, y in got)


def test_prefix_places_hold_the_rarest_common_token_of_all_similar_passages():
    rng = np.random.default_rng(9)
    least, similarity = 8, 0.8
    rungs = sd.prefix_rungs(least)
    found = 0
    for _ in range(60):
        # common tokens are the even ones, the rarer the smaller; a text repeats some; others hold uncommon tokens of any rank
        tokens = np.where(rng.random(40) < 0.85, 2 * rng.integers(1, 60, 40), 2 * rng.integers(0, 60, 40) + 1).astype(np.uint64)
        rank = np.where((tokens % 2 == 1) & (tokens % 3 == 0), 0, tokens).astype(np.uint64)
        cuts = np.array([0, 25, 40])
        if found % 2:
            tokens[:18], rank[:18] = tokens[0], rank[0]
        before = np.array([max([j for j in range(i) if tokens[j] == t], default=-1) for i, t in enumerate(tokens)])
        places = sd.prefix_places(rank, before, cuts, rungs, similarity)
        keys = {int(t) for t in tokens[places]}
        assert 0 not in rank[places]
        for low, high in zip(cuts, cuts[1:], strict=False):
            for b in range(low, high):
                for e in range(b + least, min(high, b + 2 * least - 1) + 1):
                    own = set(tokens[b:e].tolist())
                    common = {t for t in own if t % 2 == 0}
                    if len(common) >= similarity * len(own):
                        found += 1
                        assert min(common) in keys
    assert found > 1000


def sample_passages(rng, n):
    """Two texts with one passage each, edited in the second; similarity of the passages by definition."""
    pairs = []
    while len(pairs) < n:
        passage = words(rng, rng.randint(60, 160))
        edited = list(passage)
        for _ in range(rng.randint(1, 4)):
            edited[rng.randrange(len(edited))] = f"edit{rng.randrange(10 ** 6)}"
        one, two = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (passage, edited))
        if len(one & two) / len(one | two) >= 0.8:
            pairs.append((words(rng, 80) + passage + words(rng, 50), words(rng, 30) + edited + words(rng, 90)))
    return pairs


def test_recall_of_edited_passages(docs):
    rng = random.Random(11)
    pairs = sample_passages(rng, 120)
    rows = [(2 * i + side, " ".join(text)) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    found, _, texts = sd.passage_links(docs(*rows))
    ids = {r["node"]: r["first"] for r in texts.collect()}
    links = found.select("a", "b").distinct().collect()
    assert all(ids[r["a"]] // 2 == ids[r["b"]] // 2 for r in links)
    assert len(links) >= 0.95 * len(pairs)


def test_a_phrase_of_all_texts_pairs_none_and_a_passage_of_all_pairs_each_once(docs, monkeypatch):
    rng = random.Random(12)
    phrase, passage, near = words(rng, 30), words(rng, 70), words(rng, 60)
    rows = []
    for i in range(1200):
        body = words(rng, 60) + phrase + words(rng, 40)
        if i % 2:
            body += passage
        if i in (4, 800):
            body += words(rng, 9) + near
        rows.append((i, " ".join(body)))
    compared = []

    def counted(members, verify):
        def count(pairs):
            compared.append(pairs.count())
            return verify(pairs)
        return link_by_leaders(members, count)

    monkeypatch.setattr(sd, "link_by_leaders", counted)
    got = sd.repeated_passages(docs(*rows)).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(1200) if i % 2} | {4, 800}
    assert sum(compared) < 3 * len(rows)


def test_dense_parts_keep_all_prefix_places_whatever_is_marked():
    rng = np.random.default_rng(13)
    rungs = sd.prefix_rungs(8)
    for kinds in (3, 20, 400):
        for _ in range(30):
            n = int(rng.integers(0, 200))
            token = rng.integers(1, kinds + 1, n).astype(np.uint64)
            before = sd.stood_before(token, np.zeros(n, int))
            rank = np.where(token % 5 == 0, 0, token).astype(np.uint64)
            cuts = np.unique([0, n // 3, n])
            dense = sd.dense_parts(before, rank == 0, cuts, rungs)
            some = sd.dense_parts(before, (rank == 0) & (rng.random(n) < 0.4), cuts, rungs)
            assert not (sd.prefix_places(rank, before, cuts, rungs) & ~dense).any() and not (dense & ~some).any()
    fresh = np.full(100, -1)
    assert not sd.dense_parts(fresh, np.ones(100, bool), np.array([0, 100]), rungs).any()
    assert sd.dense_parts(np.arange(100) - 1, np.ones(100, bool), np.array([0, 100]), rungs)[1:].all()  # one token, again and again


def test_tokens_around_a_common_phrase_go_no_further(docs, monkeypatch):
    rng = random.Random(14)
    phrase, passage = words(rng, 14), words(rng, 60)
    rows = [(i, " ".join(words(rng, 80) + phrase + words(rng, 80) + (passage if i in (3, 90) else []))) for i in range(200)]
    sizes = {}

    def counted(df, name, store=sd.stored):
        out = store(df, name)
        if name == "windows":
            sizes[name] = sum(sum(r[0][1::2]) - sum(r[0][::2]) for r in out.select("bounds").collect())
        if name == "ranges":
            sizes[name] = sum(len(r[0]) for r in out.select("tokens").collect())
        return out

    monkeypatch.setattr(sd, "stored", counted)
    got = sd.repeated_passages(docs(*rows)).collect()
    assert {r["doc_id"] for r in got} == {3, 90}
    assert 0 < sizes["ranges"] < sizes["windows"] / 2, sizes


def test_a_passage_without_a_sampled_token_is_found(docs):
    rng = random.Random(15)
    found = {}
    for word in range(12):  # one shingle in each of these passages; some are sampled, some are not
        found[bool(sd.sampled(sd._read(sd.pa.array([f"r{word} " * 5]))[0])[0])] = f"r{word} "
    for word in found.values():
        rows = [(i, " ".join(words(rng, 70)) + " " + word * 120 + " ".join(words(rng, 20 + i))) for i in range(2)]
        assert {r["doc_id"] for r in sd.repeated_passages(docs(*rows)).collect()} == {0, 1}
    assert set(found) == {False, True}


def test_groups_of_the_same_members_are_one(spark, monkeypatch):
    sizes = {}

    def counted(df, name, store=linking.stored_alone):
        out = store(df, name)
        sizes[name] = out.count() + sizes.get(name, 0)
        return out

    monkeypatch.setattr(linking, "stored_alone", counted)
    members = spark.range(400).selectExpr("id as key", "explode(array(1L, 2L, 3L, 4L, 5L)) as id").union(
        spark.createDataFrame([(1000, 1), (1000, 2), (1001, 9)], "key bigint, id bigint"))
    links = link_by_leaders(members, lambda pairs: pairs.filter("a < 3"))
    assert sizes["members"] == 7 and sizes["met"] < 30
    assert {(1, 2), (1, 3), (1, 4), (1, 5)} <= {(r["a"], r["b"]) for r in links.collect()}


def test_a_few_open_members_all_lead_at_once(spark):
    rows = [(1, i) for i in range(100)] + [(2, i) for i in range(200, 207)]
    calls = []

    def verify(pairs):
        calls.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.filter("a = 0 or b = 0 or a = 203 and b = 205")

    members = spark.createDataFrame([*rows, *[(3 + i, x) for i in range(99) for x in (0, i + 1)]], "key bigint, id bigint")
    links = {(r["a"], r["b"]) for r in link_by_leaders(members, verify).collect()}
    assert len(calls) == 2 and {(a, b) for a in range(200, 207) for b in range(a + 1, 207)} <= calls[0] | calls[1]
    assert links == {(0, i) for i in range(1, 100)} | {(203, 205)}


def test_empty_table(docs):
    assert sd.repeated_passages(docs((1, "a")).limit(0)).count() == 0
