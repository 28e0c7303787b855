"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of an item (an item of fewer words is one window). Windows are the sets of
the join, words their tokens. Words are ordered by rarity, as counted over all documents; as a match must
contain its window whole, the prefix that has to be joined is the one rarest word of a window. Places of
prefix words in the documents are joined to the windows; the place of the word in the window fixes where
the window would begin (positional bound), and it must fit into the document (length bound). What is left
is verified word by word, and the places that verified windows cover are counted.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. Every window of every item takes
part. Tasks read texts as word hashes, and give the places of prefix words with the words around them (25 at
most); all joins and counts are Spark's, and compare words, not hashes. Hashes of the prefix words are sent to all tasks
where they are at most ``MOST_WORDS`` (8 bytes each; a larger vocabulary makes tasks give the places of all words).
Windows and their items are sent to all tasks where they are at most ``SMALL_WINDOWS``, counted with the item each; else the same joins shuffle.

Defined results: null and empty texts have no words and no hits; equal windows of several items count for
each item; rows that repeat an id with the same text get the same result each; with another text their own.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.session import stored

WINDOW = 13
SMALL_WINDOWS = 100_000
MOST_WORDS = 8_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NORMAL = np.where(wh.WORD_BYTES == 1, wh.LOWER - 1, 32).astype(np.uint8)
PLACES = 20_000  # places written at a time


def words_of(text: Column) -> Column:
    """The words in order. Only A-Z are lower-cased; plain ASCII takes the faster function."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """``_item, _window`` (words); distinct."""
    words = items.select(F.col(f"`{item_col}`").alias("_item"), words_of(F.col(f"`{text_col}`")).alias("_w")).filter(
        F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    return words.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("_window")).distinct()


def _hashes(words: DataFrame) -> np.ndarray:
    """Sorted hashes of a bounded number of words, as tasks compute them."""
    column = words.toArrow().column(0).combine_chunks()
    data, offsets = wh.text_buffers(column)
    return np.sort(wh.run_hashes(data, offsets[:-1], offsets[1:]))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their hashes."""
    for batch in batches:
        data, offsets = wh.text_buffers(batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(wh.run_hashes(data, offsets[:-1], offsets[1:]).view(np.int64))], ["_word", "_hash"])


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return np.flatnonzero(wanted[at] == hashes)


def _word_counts(wanted):
    """Counts of words by hash; of all words if none are ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "_text"):
                hashes = wh.words(*wh.text_buffers(part.column("_text")))[0]
                if wanted is not None:
                    hashes = hashes[_among(hashes, wanted.value)]
                word, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["_hash", "_n"])
    return run


def _word_places(wanted, size: int):
    """A row for each text (``_pos`` -1) with its number of words, and one for each place of a word by hash,
    with the words that a window around it could hold (``_context``, from word ``_from`` on)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "_text"):
                data, offsets = wh.text_buffers(part.column("_text"))
                hashes, begin, end, first = wh.words(data, offsets)
                count, none = np.diff(first), np.full(part.num_rows, -1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_row"), pa.array(count), pa.array(none), pa.array(none),
                     pa.nulls(part.num_rows, pa.string())], NAMES)
                normal = NORMAL[data]
                places = np.arange(len(hashes)) if wanted is None else _among(hashes, wanted.value)
                for i in range(0, len(places), PLACES):
                    at = places[i:i + PLACES]
                    text = np.searchsorted(first, at, "right") - 1
                    low = np.maximum(at - size + 1, first[text])
                    left, right = begin[low], end[np.minimum(at + size, first[text + 1]) - 1]
                    cut = np.concatenate(([0], np.cumsum(right - left)))
                    body = normal[np.arange(cut[-1]) + np.repeat(left - cut[:-1], right - left)]
                    context = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(body))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_id").take(pa.array(text)), part.column("_row").take(pa.array(text)),
                         pa.array(count[text]), pa.array((at - first[text]).astype(np.int32)),
                         pa.array((low - first[text]).astype(np.int32)), context.cast(pa.string())], NAMES)
    return run


NAMES = ["_id", "_row", "n_words", "_pos", "_from", "_context"]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
                  small_windows: int = SMALL_WINDOWS, most_words: int = MOST_WORDS) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_hit, n_items, item_ids`` (sorted as strings)."""
    owners = item_windows(items, item_col, item_text_col, size)
    windows = owners.select("_window").distinct().select("_window", F.sha2(F.array_join("_window", " "), 256).alias("_wid"))
    small = owners.count() <= small_windows
    sent = F.broadcast if small else (lambda df: df)

    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    # Rarity over all documents, of the words that can be in a prefix.
    alphabet = stored(windows.select(F.explode("_window").alias("_word")).distinct().mapInArrow(_named, "_word string, _hash bigint"), "alphabet")
    few = alphabet.count() <= most_words
    wanted = context.broadcast(_hashes(alphabet.select("_word"))) if few else None
    counts = (rows.select("_text").mapInArrow(_word_counts(wanted), "_hash bigint, _n bigint")
              .groupBy("_hash").agg(F.sum("_n").alias("_n")).join(sent(alphabet), "_hash").select("_word", "_n"))
    spots = (windows.select("_wid", "_window", F.posexplode("_window").alias("_offset", "_word"))
             .join(counts, "_word", "left"))
    rarest = Window.partitionBy("_wid").orderBy(F.coalesce("_n", F.lit(0)), "_word", "_offset")
    prefixes = stored(spots.withColumn("_k", F.row_number().over(rarest))
                      # a window with a word that no document has cannot occur
                      .filter((F.col("_k") == 1) & F.col("_n").isNotNull()).select("_wid", "_window", "_offset", "_word"),
                      "prefixes")

    wanted = context.broadcast(_hashes(prefixes.select("_word").distinct())) if few else None
    seen = stored(rows.mapInArrow(_word_places(wanted, size),
                                  f"_id {id_type}, _row bigint, n_words bigint, _pos int, _from int, _context string"), "word-places")
    places = seen.filter("_pos >= 0").withColumn("_words", F.split("_context", " +")).withColumn(
        "_word", F.get("_words", F.col("_pos") - F.col("_from")))
    begin = F.col("_pos") - F.col("_offset")
    found = (places.join(sent(prefixes), "_word")
             .filter((begin >= F.col("_from")) & (begin - F.col("_from") + F.size("_window") <= F.size("_words")))
             .filter(F.slice("_words", begin - F.col("_from") + 1, F.size("_window")) == F.col("_window"))
             .select("_id", "_row", begin.alias("_begin"), (begin + F.size("_window")).alias("_end"), "_wid").distinct())
    found = stored(found, "windows-found")

    by_place = Window.partitionBy("_id", "_row").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    covered = (found.groupBy("_id", "_row", "_begin").agg(F.max("_end").alias("_end"))
               .withColumn("_before", F.coalesce(F.max("_end").over(by_place), F.lit(0)))
               .groupBy("_id", "_row").agg(F.sum(F.greatest(
                   F.col("_end") - F.greatest("_begin", "_before"), F.lit(0))).cast("bigint").alias("n_hit")))
    owners = owners.select("_item", F.sha2(F.array_join("_window", " "), 256).alias("_wid"))
    named = (found.select("_id", "_row", "_wid").distinct().join(sent(owners), "_wid")
             .groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("item_ids")))
    hits = covered.withColumnsRenamed({"_id": "_i", "_row": "_r"}).join(
        named, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row"))).select("_i", "_r", "n_hit", "item_ids")
    return (seen.filter("_pos < 0").select("_id", "_row", "n_words")
            .join(hits, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row")), "left")
            .select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("_row").alias("text_hash")))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are in windows of the benchmark."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text_col, **names).filter(
        is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col(id_col).alias("_bad"), F.col("text_hash").alias("_row")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["_row"]), "left_anti")
