"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

A text is cut where its content says so: a chunk ends at a line break, or at a sentence end that
follows one of a few letters, after ``MIN_CHARS`` characters, and at ``MAX_CHARS`` at the latest.
The same passage gives the same chunks wherever it stands. Each chunk content gets one identifier; the
ordered list of identifiers (the recipe) stands for the text, so that only ids, lengths and recipes are
compared, grouped and joined. A long document moves once, as chunks, combined before the shuffle.

Identifiers are verified: contents are grouped as they are, and where two contents share a fingerprint
(``fingerprint`` may be any function, tests use a bad one) both get an identifier from their own rank.

Defined results: a null text counts as empty; empty texts form one group (an empty recipe); a null id
is kept as a row and never wins over an id; of repeated rows with the same largest id all are kept,
as they are the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.session import stored

MIN_CHARS, MAX_CHARS = 256, 4096
CUT = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?:\n|[aeiou][.!?]\s)|.{{1,{MAX_CHARS}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def _contents(chunked: DataFrame) -> DataFrame:
    """Each fingerprint with each of its contents once; the only place where texts are shuffled."""
    return chunked.select(F.explode("_chunks").alias("c")).select(
        F.col("c._fp").alias("_fp"), F.col("c._chunk").alias("_chunk")).distinct()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``_id, _n_chars, _recipe, _sha`` of each row; equal texts are those with equal length and recipe."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    chunked = rows.select("_id", "_text", F.transform(
        chunks_of(F.col("_text")),
        lambda c: F.struct(fingerprint(c).cast("bigint").alias("_fp"), c.alias("_chunk"))).alias("_chunks"))
    plain = chunked.select(
        "_id", F.char_length("_text").alias("_n_chars"), F.sha2("_text", 256).alias("_sha"),
        F.transform("_chunks", lambda c: F.struct(c["_fp"].alias("fp"), F.lit(0).alias("rank"))).alias("_recipe"))
    contents = _contents(chunked)
    shared = stored(contents.groupBy("_fp").agg(F.count("*").alias("_n")).filter("_n > 1").select("_fp"), "shared-prints")
    if shared.isEmpty():
        return plain
    clash = contents.join(shared, "_fp", "left_semi").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_fp").orderBy("_chunk")))
    # Only rows that hold a shared fingerprint are rebuilt, from their own chunks.
    numbered = chunked.withColumn("_row", F.sha2("_text", 256)).dropDuplicates(["_row"])
    ranked = (numbered.select("_row", F.posexplode("_chunks").alias("_pos", "c"))
              .select("_row", "_pos", F.col("c._fp").alias("_fp"), F.col("c._chunk").alias("_chunk"))
              .join(clash, ["_fp", "_chunk"])
              .groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_rank"))).alias("_ranks")))
    return (plain.join(ranked, plain["_sha"] == ranked["_row"], "left")
            .select("_id", "_n_chars", "_sha", F.when(F.col("_ranks").isNull(), F.col("_recipe")).otherwise(
                F.transform("_recipe", lambda c, i: F.struct(
                    c["fp"].alias("fp"), F.coalesce(F.col("_ranks")[i], F.lit(0)).alias("rank")))).alias("_recipe")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Per row: ``id_col, keep_id, group_size, kept, text_sha256, n_chunks``.

    Recipes are grouped with partial aggregates; the join back has one row a group on its other side,
    so a group that holds a third of all rows is split by the adaptive skew join.
    """
    rows = recipes(docs, id_col, text_col, fingerprint)
    groups = rows.groupBy("_n_chars", "_recipe").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return (rows.join(groups, ["_n_chars", "_recipe"])
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"),
                    F.size("_recipe").alias("n_chunks")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    keep = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")
