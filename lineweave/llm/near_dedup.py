"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its five-word shingles, weighted by their counts up to ``MAX_WEIGHT``: at 1, where
similarity is the Jaccard similarity of the sets, a phrase that a text repeats a hundred times counts
no more than any other. Darts are thrown by hash at the plane of weight and rank: each unit of an element's weight is a cell, and in each interval of ranks
a cell gets a Poisson number of darts, each with a rank and a coordinate, all from the hash of the cell. So
equal cells get equal darts in every text. Intervals are gone through from rank 0 until every coordinate
has a dart; the earliest dart of a coordinate is its value. The work is one look at each cell and interval
and a few darts a coordinate, however large the set. Two texts agree in a coordinate with the probability
of their weighted Jaccard similarity.

Bands of ``ROWS`` coordinates are join keys. Equal texts are one node, so copies cost one row each. In each band group one
leader is compared with the others (``linking.link_to_leaders``), and each link is verified: Jaccard similarity of the shingles of
the whole texts, at least ``SIMILARITY``. Members of groups that this leaves in several classes meet in a prefix-filtered
join (``prefix_pairs``), which is exact at any size of a group: with shingles ordered from rare to frequent, two texts that are
similar enough share one of the first fifth (and one more) of theirs. So the shingles of a template or a common passage
are no keys, unless a text has hardly others. Length and place bound what is compared, and texts of one class are not compared
again. Classes are the components of all links.

Defined results: null counts as empty; texts without words are alike only where equal; a text of fewer than
five words is one shingle; a row with a null id is compared with nothing, unless its text is equal to that
of a row with an id, whose class it gets, else its class is null and it stays; rows with one id and several texts are
one document that is similar to what either text is similar to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.llm.linking import components, link_to_leaders
from lineweave.session import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
MAX_WEIGHT = 1
U = np.uint64
# Rank intervals: short ones first, as large sets need few darts a cell; then unit intervals.
SHORT = [(0.0, 0.125), (0.125, 0.125), (0.25, 0.25), (0.5, 0.5)]


def _steps(length: float) -> np.ndarray:
    """Distribution function of the Poisson number of darts in an interval, over all 64-bit values."""
    p, total, out = math.exp(-length), 0.0, []
    for k in range(14):
        total += p
        out.append(min(int(total * 2.0 ** 64), 2 ** 64 - 1))
        p *= length / (k + 1)
    return np.array(out, np.uint64)


def cells(shingle: np.ndarray, start: np.ndarray, max_weight: int = MAX_WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of the weighted sets: a hash of (shingle, which of its occurrences), and the text of each."""
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((shingle, text))
    s, t = shingle[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    cell, own = wh.mix(s + nth.astype(np.uint64) * U(0xA24BAED4963EE407)), nth < max_weight
    return cell[own], t[own]


def dart_signatures(cell: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """``n_texts x k`` values; texts without cells have zeros. ``text`` is sorted.

    A dart is one 64-bit value: the high bits are its rank within the interval, the low 24 its coordinate.
    """
    value = np.zeros(n_texts * k, np.uint64)
    interval, low = 0, 1
    while len(cell):
        if interval < len(SHORT):
            begin, length = SHORT[interval]
            units = np.array([int(begin * 8)], np.uint64)
        else:  # the fewer cells are left, the more unit intervals at a time
            n_units = max(1, min(512, 16384 // len(cell)))
            units, length = np.arange(low, low + n_units, dtype=np.uint64) * U(8), 1.0
            low += n_units
        units = (units + U(1)) * U(0x9FB21C651E98DF25)
        seed = wh.mix((units[:, None] + cell).ravel())
        darts = np.searchsorted(_steps(length), seed, "right")
        hit = np.flatnonzero(darts)
        many = darts[hit]
        source = np.repeat(hit, many)
        nth = (np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + 1).astype(np.uint64)
        dart = wh.mix(seed[source] + nth * U(0xD1342543DE82EF95))
        slot = text[source % len(cell)] * k + ((dart & U(0xFFFFFF)) * U(k) >> U(24)).astype(np.int64)
        free = np.flatnonzero(value[slot] == 0)  # coordinates without a dart of an earlier interval
        slot, dart, source = slot[free], dart[free], source[free]
        if len(units) == 1:
            value[slot] = U(2 ** 64 - 1)
            np.minimum.at(value, slot, dart)
        else:  # of several writes to a slot the last one stays: that of the earliest dart
            late = np.lexsort((dart, source // len(cell)))[::-1]
            value[slot[late]] = dart[late]
        interval += 1
        active = (value == 0).reshape(n_texts, k).any(axis=1)[text]
        cell, text = cell[active], text[active]
    return value.reshape(n_texts, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    folded = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    shaped = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        folded = wh.mix(folded + shaped[:, :, j])
    return folded


def _signature_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                data, offsets = wh.text_buffers(part.column("text"))
                hashes, _, _, first = wh.words(data, offsets)
                shingle, start = wh.shingles(hashes, first, SHINGLE)
                cell, text = cells(shingle, start)
                keys = band_keys(dart_signatures(cell, text, part.num_rows, bands * rows), bands, rows).view(np.int64)
                filled = np.diff(start) > 0
                at = np.concatenate(([0], np.cumsum(np.where(filled, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("sha"),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(keys[filled].ravel()))], ["id", "sha", "keys"])
    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the pairs of texts; those that reach the threshold."""
    def counted(column):
        data, offsets = wh.text_buffers(column)
        hashes, _, _, first = wh.words(data, offsets)
        return wh.shingles(hashes, first, SHINGLE)

    for batch in batches:
        for part in wh.slices(batch, "text_b"):
            for row in range(part.num_rows):
                one = part.slice(row, 1)
                s, n = [], []
                for name in ("text_a", "text_b"):
                    u, c = np.unique(counted(one.column(name))[0], return_counts=True)
                    s.append(u), n.append(np.minimum(c, MAX_WEIGHT))
                total = n[0].sum() + n[1].sum()
                _, i, j = np.intersect1d(s[0], s[1], assume_unique=True, return_indices=True)
                same = np.minimum(n[0][i], n[1][j]).sum()
                if total and same >= SIMILARITY * (total - same):
                    yield pa.RecordBatch.from_arrays(
                        [one.column("a"), one.column("b"), pa.array([same / (total - same)])], ["a", "b", "similarity"])


# --- the exact second way ----------------------------------------------------------------------------------------

FREQUENT = 16  # texts that hold a shingle before it may count as frequent
MOST_FREQUENT = 1 << 18  # shingles whose counts are broadcast, at most; others are rare


def _distinct_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    hashes, _, _, first = wh.words(*wh.text_buffers(column))
    shingle, start = wh.shingles(hashes, first, SHINGLE)
    for i in range(len(start) - 1):
        yield np.unique(shingle[start[i]:start[i + 1]])


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a part of the rows hold each shingle."""
    for batch in batches:
        for part in wh.slices(batch, "text"):
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_distinct_shingles(part.column("text"))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])


def frequent_shingles(bodies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts; ``MOST_FREQUENT`` at most. What is not among them counts as rare."""
    counted = bodies.select("text").mapInArrow(_shingle_counts, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    often = stored(counted.filter(F.col("n") >= FREQUENT), "frequent-shingles")
    levels = {r["level"]: r["tokens"] for r in often.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(
        F.count("*").alias("tokens")).collect()}  # a row for each power of two
    level, total = 64, 0
    for k in sorted(levels, reverse=True):
        total += levels[k]
        if total > MOST_FREQUENT:
            break
        level = k
    rows = often.filter(F.floor(F.log2("n")) >= level).select("token", "n").toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], rows.column("n").to_numpy()[order]


def least_overlap(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set that is similar enough."""
    return math.ceil(SIMILARITY * n - 1e-9)


def _prefix_rows(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            for part in wh.slices(batch, "text"):
                tokens, rows = [], []
                for i, own in enumerate(_distinct_shingles(part.column("text"))):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
                    prefix = own[:len(own) - least_overlap(len(own)) + 1] if len(own) else own
                    tokens.append(prefix.view(np.int64))
                    rows.append((np.full(len(prefix), i), np.full(len(prefix), len(own)), np.arange(len(prefix))))
                row, size, place = (np.concatenate(x) for x in zip(*rows, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), part.column("node").take(take), part.column("cls").take(take),
                     pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "node", "cls", "size", "place"])
    return run


def prefix_pairs(open_: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: pairs of open nodes (``id, cls``) of different classes that can be similar; none that is similar is missing.

    For each shingle, those that are not in its most frequent class are compared with all, so that a class that holds a
    shingle many times costs a row for each of its members and each text outside of it.
    """
    own = bodies.join(open_.select(F.col("id").alias("node"), "cls"), "node")
    frequent = open_.sparkSession.sparkContext.broadcast(frequent_shingles(own))
    rows = own.select("node", "cls", "text").mapInArrow(_prefix_rows(frequent), "token bigint, node bigint, cls bigint, size int, place int")
    mixed = rows.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("token")
    rows = stored(rows.join(mixed, "token", "left_semi"), "prefixes")
    top = (rows.groupBy("token", "cls").agg(F.count("*").alias("n")).groupBy("token").agg(
        F.max_by("cls", F.struct("n", "cls")).alias("top")))
    marked = rows.join(top, "token")
    a = marked.filter("cls <> top").select("token", *[F.col(c).alias(f"a_{c}") for c in ("node", "cls", "size", "place")])
    b = marked.select("token", "top", *[F.col(c).alias(f"b_{c}") for c in ("node", "cls", "size", "place")])
    # the first shingle that two texts share has all their common ones behind it, in both; later ones need not pass
    needed = F.ceil((F.col("a_size") + F.col("b_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    short, long = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    return (a.join(b, "token").filter((F.col("a_cls") != F.col("b_cls")) & ((F.col("b_cls") == F.col("top")) | (F.col("a_node") < F.col("b_node")))
                                      & (short >= long * SIMILARITY - 1e-9) & (left >= needed))
            .select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``id_col, class_id`` (smallest id of the class), ``kept``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    signed = base.filter("id is not null").mapInArrow(_signature_rows(bands, rows), "id bigint, sha binary, keys array<bigint>")
    texts = stored(signed.groupBy("sha").agg(F.min("id").alias("node"), F.any_value("keys").alias("keys")), "texts")
    bands_of = texts.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    shared = bands_of.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = stored(bands_of.join(shared, "key", "left_semi"), "bands")
    wanted = members.select(F.col("id").alias("node")).distinct().join(texts.select("node", "sha"), "node")
    bodies = stored(base.join(wanted, (F.col("id") == F.col("node")) & (base["sha"] == wanted["sha"]))
                    .select("node", base["sha"], "text").dropDuplicates(["node", "sha"]).drop("sha"), "bodies")

    def verify(pairs: DataFrame) -> DataFrame:
        a = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return (pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
                .mapInArrow(_similar, "a bigint, b bigint, similarity double"))

    links, open_ = link_to_leaders(members, verify)
    if not open_.isEmpty():
        more = verify(stored(prefix_pairs(open_, bodies), "prefix-pairs")).select("a", "b")
        links = links.unionByName(stored(more, "prefix-links"))
    classes = components(links).withColumnRenamed("id", "node")
    nodes = texts.select("sha", "node").join(classes, "node", "left").select("sha", F.coalesce("class_id", "node").alias("class_id"))
    out = base.select("id", "sha").join(nodes, "sha", "left")
    return out.select(F.col("id").alias(id_col), "class_id",
                      F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"),
                      F.hex("sha").alias("text_sha"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each class the document with the smallest id."""
    groups = near_groups(docs, id_col, text_col)
    gone = groups.filter(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha").alias("_sha")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (
        F.upper(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)) == gone["_sha"]), "left_anti")
