"""Cross-site line dedup by distinct-site spread; DataFrame functions only.

A line (trimmed, blank lines apart) that stands on many sites is boilerplate. Its spread is sketched: one
HyperLogLog sketch of sites per line hash, merged by the aggregation. Lines whose estimate is so near the
threshold that the sketch cannot tell get an exact distinct count. Boilerplate goes from every document
but the one with the smallest id, so that no line, and no text that many sites copy, vanishes.

Only hashes, sites and ids are shuffled for the decision; lines of one document are made distinct before.
The texts move once, by document, to get their line numbers. A line that a third of all documents hold is
combined before the shuffle, and the join that finds its places can be split, as it has one row a line.

Defined results: a null text gives an empty text and no lines; a null site counts for no site; rows with
a null id are never the first holder unless no row with an id holds the line, then all of them keep it;
rows that repeat an id are one holder; columns named like an output (``n_lines``, ``n_removed``) are
replaced. Line ends are ``\\n``; kept lines stay unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.session import stored

MIN_SITES = 10
LOG2_K = 12
SIGMAS = 4.0


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128 bits of a trimmed line; null for a blank one."""
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.when(trimmed != "", F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(7), trimmed).alias("b")))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                 min_sites: int = MIN_SITES, log2_k: int = LOG2_K) -> DataFrame:
    """Lines on at least ``min_sites`` sites: ``_a, _b`` (hash), ``n_sites``, ``exact``, ``_first`` (smallest id)."""
    held = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{site_col}`").cast("string").alias("_site"),
        F.explode(F.array_distinct(F.transform(_lines(F.col(f"`{text_col}`")), _key))).alias("_k")
    ).filter("_k is not null").select("_id", "_site", F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"))
    margin = SIGMAS * 1.04 / math.sqrt(2 ** log2_k)
    low, high = math.floor(min_sites * (1 - margin)), math.ceil(min_sites * (1 + margin))
    sketched = held.groupBy("_a", "_b").agg(
        F.hll_sketch_agg("_site", F.lit(log2_k)).alias("_sketch"), F.min("_id").alias("_first"))
    likely = stored(sketched.select("_a", "_b", "_first", F.hll_sketch_estimate("_sketch").alias("n_sites"))
                    .filter(F.col("n_sites") >= low), "line-spread")
    near = likely.filter(F.col("n_sites") <= high)
    counted = (held.join(near.select("_a", "_b"), ["_a", "_b"], "left_semi")
               .select("_a", "_b", "_site").distinct()
               .groupBy("_a", "_b").agg(F.count("_site").alias("n_sites")).filter(F.col("n_sites") >= min_sites))
    return (likely.filter(F.col("n_sites") > high).select("_a", "_b", "n_sites", F.lit(False).alias("exact"), "_first")
            .unionByName(near.drop("n_sites").join(counted, ["_a", "_b"]).withColumn("exact", F.lit(True))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, log2_k: int = LOG2_K) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines gone from the text, and ``n_lines, n_removed``."""
    spread = stored(spread_lines(docs, id_col, text_col, site_col, min_sites, log2_k), "line-boilerplate")
    text = F.col(f"`{text_col}`")
    places = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"),
        F.posexplode(F.transform(_lines(text), _key)).alias("_pos", "_k")).filter("_k is not null")
    gone = (places.select("_id", "_row", "_pos", F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"))
            .join(spread.select("_a", "_b", "_first"), ["_a", "_b"])
            .filter(~F.col("_id").eqNullSafe(F.col("_first")))
            .groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_gone")))
    lines, cut = _lines(text), F.col("_gone")
    bounds = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.slice(
        lines, bounds[i] + 2, bounds[i + 1] - bounds[i] - 1)))
    rows = docs.drop("n_lines", "n_removed").join(
        gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_row"]),
        "left")
    return rows.withColumns({
        "n_lines": F.size(F.filter(lines, lambda line: F.btrim(line, F.lit(" \t\r")) != "")),
        "n_removed": F.when(cut.isNull(), 0).otherwise(F.size(cut)),
        text_col: F.when(cut.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")),
    }).drop("_gone", "_row", "_id")
