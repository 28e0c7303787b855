import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lineweave.llm import conversation_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t, key(role, text), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def totals(p):
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        below = [totals(c) for c in children[p]]
        return max(1, sum(b[0] for b in below)), own + sum(b[1] for b in below)
    out = []
    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(full[c]) == len(p)))
        leaves, saved = totals(p)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in trie.OUTPUT) for r in trie.conversation_trie(df, **options).collect()), key=str)


def made_rows(seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in [*rnd.sample(range(-45, 300), 150), *range(1000, 1100)]:
        if c >= 1000:  # a hot beginning and many copies
            texts = ["hello there", "a b", "c"][:rnd.choice([1, 2, 3, 3])]
        else:
            texts = [rnd.choice(["x", "y z", None, "", " \x0b", "one two three"]) for _ in range(rnd.randint(1, 5))]
        rows += [(c, t, rnd.choice(["u", None]) if c < 300 else "u", x) for t, x in enumerate(texts)]
    rows += [(7777, t, "u", f"long {t}") for t in range(300)] + [(7778, t, "u", f"long {t}") for t in range(250)]
    rows += [(5, None, "u", "first"), (5, None, "a", "first too"), (None, 0, "u", "nobody"), (9, 1, "u", "same"), (9, 1, "u", "same")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_against_the_definition(spark, shards):
    rows = made_rows()
    assert found(spark, rows, shards=shards) == brute(rows)


def test_copies_spread_over_all_shards(spark):
    rows = [(c, t, "u", f"turn {t} x") for c in range(400) for t in range(3)]
    assert found(spark, rows, shards=9) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    rows = [(c, 0, "u", "x") for c in range(21, 40)]  # no base: some lose their only turn
    assert found(spark, rows) == brute(rows)


def test_find_close_of_random_parentheses():
    rnd = random.Random(3)
    for size in (1, 2, 5, 70, 4000):
        for tendency in (0.5, 0.95):
            bits, depth, left = [1], 1, size - 1
            while depth:
                if left and (depth == 1 or rnd.random() < tendency):
                    bits, depth, left = [*bits, 1], depth + 1, left - 1
                else:
                    bits, depth = [*bits, 0], depth - 1
            stack, wanted = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    wanted[stack.pop()] = i
            bits = np.array(bits)
            opens = np.flatnonzero(bits)
            assert trie.find_close(bits, np.cumsum(2 * bits - 1), opens).tolist() == [wanted[i] for i in opens]
