"""Packing into optimal length buckets.

Texts are cut into segments of at most ``MAX_LENGTH`` tokens, so that lengths, and the histogram over all
segments, have a fixed bound. Dynamic programming over the histogram picks the ``BUCKETS`` boundaries
with the least padding when each segment is padded to its bucket's boundary: the exact optimum, by at most
MAX_LENGTH^2 / 2 sums a bucket on the driver, whatever the number of documents. In a bucket of boundary b,
``BATCH_TOKENS // b`` segments make a batch (at least one).

Places in a bucket come from a hash order, without a task that sees a whole bucket: segments are dealt to
shards of about ``SHARD`` by hash, ranked in each (bucket, shard), and shifted by the sizes of the shards
before. So all batches but the last of a bucket are full.

A token is a run of non-white-space with the white space before it; the white space that ends a text goes
with its last token. The segments of a document, joined in order, are its text.

Defined results: null and empty texts have no segment; a text of white space only is one token; repeated
rows are packed as often as they occur; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.session import stored

MAX_LENGTH = 2048
BUCKETS = 8
BATCH_TOKENS = 32_768
SHARD = 50_000
TOKEN = r"\s*\S+(?:\s+$)?|\s+"


def best_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding; the largest length is the last."""
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    n = np.concatenate(([0], np.cumsum([counts[x] for x in lengths.tolist()]))).astype(np.int64)
    # cost[j]: padded tokens of the first j lengths in the buckets so far; padding = padded - real tokens
    cost = np.concatenate(([0], lengths * n[1:]))
    choice = []
    for _ in range(1, min(buckets, len(lengths))):
        better, at = cost.copy(), np.zeros(len(cost), np.int64)
        for j in range(1, len(cost)):
            total = cost[:j] + (n[j] - n[:j]) * lengths[j - 1]
            at[j] = np.argmin(total)
            better[j] = total[at[j]]
        choice.append(at)
        cost = better
    bounds, j = [], len(lengths)
    for at in reversed(choice):
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
        if not j:
            break
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(bounds)


def segments(docs: DataFrame, text_col: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """``docs`` without the text, with ``segment`` (from 0), ``n_tokens`` and ``segment_text``."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(TOKEN), F.lit(0))
    cut = docs.drop("segment", "n_tokens", "segment_text").withColumn("_tokens", tokens).filter(F.size("_tokens") > 0)
    parts = F.transform(F.sequence(F.lit(1), F.size("_tokens"), F.lit(max_length)), lambda i: F.slice("_tokens", i, max_length))
    return (cut.select(*[c for c in cut.columns if c not in ("_tokens", text_col)], F.posexplode(parts).alias("segment", "_part"))
            .withColumns({"n_tokens": F.size("_part"), "segment_text": F.array_join("_part", "")}).drop("_part"))


def pack(segmented: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS,
         max_length: int = MAX_LENGTH, shard: int = SHARD) -> DataFrame:
    """Adds ``bucket_length, batch, slot, padding`` to rows with ``segment, n_tokens``.

    A batch is known by (``bucket_length``, ``batch``); ``slot`` is the place in it.
    """
    segmented = segmented.drop("bucket_length", "batch", "slot", "padding")
    counts = {r["n_tokens"]: r["n"] for r in segmented.groupBy("n_tokens").agg(F.count("*").alias("n"))
              .filter(F.col("n_tokens").between(1, max_length)).collect()}  # at most max_length rows
    bounds = best_bounds(counts, buckets) or [max_length]
    shards = max(1, -(-sum(counts.values()) // shard))
    bound = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("n_tokens")), 1)
    dealt = segmented.withColumns({
        "bucket_length": bound, "_h": F.xxhash64(id_col, "segment", "n_tokens"),
    }).withColumn("_shard", F.pmod("_h", F.lit(shards)))
    sizes = dealt.groupBy("bucket_length", "_shard").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("bucket_length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(sizes.select("bucket_length", "_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")),
                    "bucket-shifts")
    ranked = dealt.withColumn("_rank", F.row_number().over(
        Window.partitionBy("bucket_length", "_shard").orderBy("_h", F.col(id_col), "segment")))
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_length")), F.lit(1))
    place = F.col("_shift") + F.col("_rank") - 1
    return (ranked.join(shifts, ["bucket_length", "_shard"])
            .withColumns({"batch": F.floor(place / per_batch).cast("bigint"), "slot": F.pmod(place, per_batch).cast("int"),
                          "padding": F.col("bucket_length") - F.col("n_tokens")})
            .drop("_h", "_shard", "_shift", "_rank"))
