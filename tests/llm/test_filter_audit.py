import itertools
import random
import re
from collections import Counter

from lineweave.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """The audit from its definition: every order is walked document by document."""
    def fails(i, part, text, n):
        text, words = text or "", WORD.findall(text or "")
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            out.add("C")
        if any(c in text for c in "#$%&*|"):
            out.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows):
            out.add("E")
        return out
    docs = [(i, p or "", fails(i, p, t, n)) for n, (i, p, t) in enumerate(rows)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f and bool(f & set(order[:step - 1])) for _, f in own),
                    sum(f == {name} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name]
    return {k: tuple(v[:6]) + (shapley[k[0], v[6]],) for k, v in out.items()}


def audited(spark, rows, labels, **options):
    docs = spark.createDataFrame([(i, t, p, "x", 0) for i, p, t in rows], "doc_id bigint, text string, source string, mask string, part int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, marks, **options).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[k] for k in filter_audit.FIGURES) for r in got}
    assert len(found) == len(got)
    return found


def made_rows():
    rnd = random.Random(5)
    texts = [None, "", " \x0b", "A b", "a # b", "x " * 300, " ".join(f"w{i}" for i in range(250)), "É" * 30 + "A",
             " ".join(f"W{i}" for i in range(400)), "a b c " * 90, " ".join(f"v{i}|" for i in range(210)),
             " ".join(f"n{i}" for i in range(60_000))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "s1", "s2"]), rnd.choice(texts)) for _ in range(120)]
    rows += [(i, "hot", "same text of a hot group") for i in range(100, 400)]
    labels = [(rnd.choice([None, *range(420)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(200)]
    return rows, labels


def test_against_the_definition(spark):
    rows, labels = made_rows()
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_a_full_filter_clears_nothing_and_changes_nothing(spark, monkeypatch):
    rows, labels = made_rows()
    wanted = brute(rows, labels)
    monkeypatch.setattr(filter_audit, "SKETCH_BYTES", 0)  # the way beyond a broadcast
    assert audited(spark, rows, labels) == wanted


def test_unique_texts_are_cleared(spark):
    docs = spark.createDataFrame([(i, f"text {i if i % 10 else 0}") for i in range(3000)], "doc_id bigint, text string")
    got = filter_audit.with_possible_repeats(docs).select("doc_id", "_possible").collect()
    assert all(r["_possible"] for r in got if r["doc_id"] % 10 == 0)
    assert sum(r["_possible"] for r in got) < 300 + 60


def test_empty_table_has_no_parts(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, None, None)], [])) == 600
