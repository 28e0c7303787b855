import itertools
import random
from collections import Counter, defaultdict

from lineweave.llm import packing


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in counts.items())


def test_bounds_are_optimal():
    for seed in range(200):
        rng = random.Random(seed)
        counts = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k, lengths = rng.randint(1, 5), sorted(counts)
        best = min(padding(counts, [*x, lengths[-1]]) for m in range(min(k, len(lengths))) for x in itertools.combinations(lengths[:-1], m))
        bounds = packing.best_bounds(counts, k)
        assert len(bounds) <= k and padding(counts, bounds) == best
    assert packing.best_bounds({}, 3) == []


def test_round_trip_batches_and_shards(docs):
    rng = random.Random(5)
    rows = [(i, " ".join("é" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 30, 95])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "  lead and trail \n"), (3, rows[3][1])]
    cut = packing.segments(docs(*rows).withColumnRenamed("kept", "batch"), max_length=40)
    got = packing.pack(cut, buckets=3, batch_tokens=100, max_length=40, shard=7).collect()
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: r["segment"]):
        assert 1 <= r["n_tokens"] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["n_tokens"]
        texts[r["doc_id"]].append(r["segment_text"])
    for i, text in rows:
        if text and i != 3:
            assert "".join(texts[i]) == text
    assert 100 not in texts and 101 not in texts and texts[102] == [" \n\t "]
    fill = Counter((r["bucket_length"], r["batch"]) for r in got)
    slots = {(r["bucket_length"], r["batch"], r["slot"]) for r in got}
    assert len(slots) == len(got)
    last = {b: max(batch for x, batch in fill if x == b) for b, _ in fill}
    for (bound, batch), n in fill.items():
        full = max(1, 100 // bound)
        assert n == full if batch < last[bound] else 1 <= n <= full


def test_empty_table(docs):
    assert packing.pack(packing.segments(docs((1, "a")).limit(0))).count() == 0
