"""Filter interaction audit: what each filter removes, alone and in every order of the filters.

A document fails a set of filters (a mask of five bits); every figure of the audit is a sum over masks. Four
filters look at one text. The fifth, "its text stands in a smaller id", needs the whole table, and a
counting Bloom filter keeps most texts out of the shuffle:

1. each task counts its text hashes in cells (0, 1, many); the sparse counts of all tasks are merged block by block;
2. a text with a cell that was hit once is unique for certain; only possible repeats go on;
3. possible repeats are grouped by their full texts, with partial aggregation, to the smallest id of each text;
4. flags, labels and smallest ids meet as counts (by text, part, mask and labels), so that a text that a third
   of all rows hold is a few rows; masks are added up and the orders are worked out from 32 counts a part.

A block is 65,536 cells; all cells of a text are in one block. The merged filter has two bytes a row. It is
broadcast up to ``SKETCH_BYTES``; a larger one is joined by block with the distinct hashes instead.

Defined results: null text counts as empty, null part as the empty string; a null id is never a repeat and
has no label; rows that repeat an id are rows of their own and no repeats of each other; with several labels
of an id a document is good (toxic) if any says so; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
BLOCK, CELLS_PER_ROW, PROBES = 1 << 16, 16, 4
SKETCH_BYTES = 128 << 20
FLUSH = 1 << 20  # rows that a task counts at a time


def text_mask(text: bytes) -> int:
    """Filters A to D that a text fails, as bits 1, 2, 4, 8. ``bytes.split`` cuts at space and 09 to 0D."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    return ((len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * (len(text) - len(text.translate(None, CAPITALS))) > 2 * points)
            + 8 * (len(text.translate(None, SYMBOLS)) < len(text)))


# --- counting Bloom filter ------------------------------------------------------------------------------------


def _hashed(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (docs.withColumn("_text", text).withColumn("_fp", F.xxhash64("_text"))
            .withColumn("_block", F.pmod("_fp", F.lit(blocks)).cast("int")).withColumn("_cells", F.xxhash64("_fp", F.lit(1))))


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: for each block the cells hit once, and those hit more often."""
    def counted(block, hashes):
        cells = hashes.view(np.uint16).reshape(-1, PROBES).astype(np.int64) + block[:, None] * BLOCK
        cells, n = np.unique(cells, return_counts=True)
        owner = cells // BLOCK
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = [(owner[i], c[m == 1].astype(np.uint16).tobytes(), c[m > 1].astype(np.uint16).tobytes())
                for i, c, m in zip(cuts, np.split(cells % BLOCK, cuts[1:]), np.split(n, cuts[1:]), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[0] for r in rows], np.int32)), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.binary())], ["block", "once", "many"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(False).astype(np.int64), np.ascontiguousarray(batch.column(1).to_numpy(False))))
        size += batch.num_rows
        if size >= FLUSH:
            yield counted(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield counted(*map(np.concatenate, zip(*held, strict=True)))


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one bit a cell: set where all tasks together counted more than one."""
    block, count = None, None

    def done():
        words = np.packbits(count > 1, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))],
                                          ["block", "bits"])

    for batch in batches:
        for at, once, many in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if at != block:
                if block is not None:
                    yield done()
                block, count = at, np.zeros(BLOCK, np.uint8)
            for cells, add in ((once, 1), (many, 2)):
                cells = np.frombuffer(cells, np.uint16)
                count[cells] = np.minimum(count[cells] + add, 2)
    if block is not None:
        yield done()


def merged_sketch(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """``block, bits`` over all rows of ``docs``."""
    counts = _hashed(docs, text_col, blocks).select("_block", "_cells").mapInArrow(
        _count_cells, "block int, once binary, many binary")
    merged = counts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_blocks, "block int, bits array<bigint>")
    return stored(merged, "audit-sketch")


_HIT = " AND ".join(
    f"getbit(bits[cast(shiftright(_cells, {16 * i + 6}) & 1023 AS INT)], cast(shiftright(_cells, {16 * i}) & 63 AS INT)) = 1"
    for i in range(PROBES))


def with_possible_repeats(docs: DataFrame, text_col: str = "text", cells_per_row: int = CELLS_PER_ROW) -> DataFrame:
    """``docs`` with ``_text`` and ``_possible``: false only where the text stands in no other row."""
    blocks = max(1, math.ceil(docs.count() * cells_per_row / BLOCK))
    sketch = merged_sketch(docs, text_col, blocks)
    rows = _hashed(docs, text_col, blocks)
    if blocks * BLOCK // 8 <= SKETCH_BYTES:
        tested = rows.join(F.broadcast(sketch), rows["_block"] == sketch["block"]).withColumn("_possible", F.expr(_HIT))
    else:  # two bytes a row are too many for one broadcast: distinct hashes meet the blocks instead
        prints = rows.select("_fp", "_block", "_cells").distinct()
        hits = stored(prints.join(sketch, prints["_block"] == sketch["block"]).filter(F.expr(_HIT))
                      .select(F.col("_fp").alias("_hit")), "audit-hits")
        tested = rows.join(hits, rows["_fp"] == hits["_hit"], "left").withColumn("_possible", F.col("_hit").isNotNull())
    return tested.select(*[F.col(f"`{c}`") for c in docs.columns], "_text", "_possible")


# --- masks ----------------------------------------------------------------------------------------------------


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        possible = batch.column(3).to_pylist()
        texts = batch.column(2).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([text_mask(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() if p else None for t, p in zip(texts, possible, strict=True)], pa.binary())],
            ["id", "part", "mask", "sha"])


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                cells_per_row: int = CELLS_PER_ROW) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail (bit 0 is A, bit 4 is E)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text_col}`").alias("body"))
    tested = with_possible_repeats(rows, "body", cells_per_row).select(
        "id", "part", "_text", (F.col("_possible") & F.col("id").isNotNull()).alias("_possible"))
    id_type = docs.schema[id_col].dataType.simpleString()
    flagged = tested.mapInArrow(_masked, f"id {id_type}, part string, mask int, sha binary")
    firsts = (tested.filter("_possible").groupBy("_text").agg(F.min("id").alias("first"), F.count("*").alias("held"))
              .filter("held > 1").select(F.unhex(F.sha2("_text", 256)).alias("first_sha"), "first"))
    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    labelled = (flagged.join(marked.hint("merge"), F.col("id") == F.col("label_id"), "left")
                .fillna(0, ["good", "toxic"])
                .groupBy("id", "part", "mask", "sha", "good", "toxic").agg(F.count("*").alias("reps")))
    by_text = labelled.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("reps").alias("n"), F.min(F.struct("id", "reps")).alias("lo"))
    repeats = (F.when(F.col("first").isNull(), 0)
               .otherwise(F.col("n") - F.when(F.col("lo.id") == F.col("first"), F.col("lo.reps")).otherwise(0)))
    split = (by_text.join(firsts.hint("merge"), F.col("sha") == F.col("first_sha"), "left").withColumn("repeats", repeats)
             .select("part", "good", "toxic", F.explode(F.array(
                 F.struct(F.col("mask"), (F.col("n") - F.col("repeats")).alias("n")),
                 F.struct((F.col("mask") + 16).alias("mask"), F.col("repeats").alias("n")))).alias("s")))
    return (split.filter("s.n > 0").groupBy("part", F.col("s.mask").alias("mask"))
            .agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"),
                 F.sum(F.col("s.n") * F.col("toxic")).alias("toxic")))


# --- orders ---------------------------------------------------------------------------------------------------

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _order_matrices() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and for each figure which of the 32 masks it counts there."""
    masks, steps, chosen = np.arange(1 << len(FILTERS)), [], {k: [] for k in FIGURES[:4]}
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before, own = sum(1 << g for g in order[:step]), 1 << f
            fails, gone = (masks & own) > 0, (masks & before) > 0
            steps.append(("".join(FILTERS[g] for g in order), step + 1))
            for key, what in zip(FIGURES, (~fails & ~gone, fails & ~gone, fails & gone, masks == own), strict=False):
                chosen[key].append(what)
    return steps, {k: np.array(v, np.int64) for k, v in chosen.items()}


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, chosen = _order_matrices()
    filters = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    same_filter = (filters[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in cells:
                counts[:, c["mask"]] = c["n"], c["good"], c["toxic"]
            found = {k: m @ counts[0] for k, m in chosen.items()}
            found["good_lost"], found["toxic_lost"] = chosen["removed"] @ counts[1], chosen["removed"] @ counts[2]
            found["shapley"] = (same_filter.T @ found["removed"])[filters]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(steps), pa.string()), pa.array([o for o, _ in steps], pa.string()),
                 pa.array([s for _, s in steps], pa.int32()), *[pa.array(found[k], pa.int64()) for k in FIGURES]],
                ["part", "filter_order", "step", *FIGURES])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          cells_per_row: int = CELLS_PER_ROW) -> DataFrame:
    """``part, filter_order, step`` and the counts of ``FIGURES``: 600 rows a part."""
    cells = mask_counts(docs, labels, id_col, text_col, part_col, cells_per_row)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audited, "part string, filter_order string, step int, " + ", ".join(f"{k} bigint" for k in FIGURES))
