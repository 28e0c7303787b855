"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

A suffix array of every byte would be many times the corpus, so the arrays here are sparse. Each window of ``length``
bytes belongs to one suffix, the one that begins at the window's least gram hash; equal windows belong to equal
suffixes at the same offset. A suffix and the run of windows that belong to it make one entry of two fingerprints:

* ``s``, of the bytes that all windows of the run share: without another suffix of the same ``s`` none of them repeats;
* ``t``, of all bytes that the windows cover: with another entry of the same ``s`` and ``t`` all of them repeat.

Within a task, each new batch of texts gets an array of entries in fingerprint order, which is merge-scanned against the
levels of a logarithmic family; equal-sized levels merge (``Family``). The families of all tasks then merge in one
shuffle, sorted by (s, t), and are scanned in order with one entry's group held at a time. Entries whose ``s`` repeats while their
``t`` does not go on with shorter runs of windows (``W``, ``W / 8``, 1), a finer level of the same search, whose last
step compares single windows. So each window is decided exactly, but for collisions of 128 bits. Entries that are known to
repeat stay as one witness a class, so that nothing is compared in pairs and a passage of any number of holders costs a row a task.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; ids are only carried, so null
and repeated ids and equal rows are rows of their own, and equal texts of ``length`` bytes or more lose everything;
an empty table gives no rows; columns other than id and text are not read. A long text is read in pieces of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

LENGTH = 200
GRAM = 16
PIECE = 1 << 18  # windows looked at together
BATCH = 1 << 14  # entries of a new batch of the family
FLUSH = 1 << 20  # entries that a family holds before it starts anew
MARGIN = 1 << 13
SPAN, UNDECIDED, WITNESS = 0, 1, 2
U = np.uint64
ROW = "s bigint, t bigint, k1 bigint, k2 bigint, item bigint, n int"
FOUND = "k1 bigint, k2 bigint, item bigint, state int"


def window_count(length: int) -> int:
    """Windows that share a suffix at most: a power of two, about two thirds of ``length``."""
    if not 12 <= length <= 4096:
        raise ValueError("length must be between 12 and 4096 bytes")
    return 1 << ((2 * length // 3).bit_length() - 1)


def pack(ps, hi, lo):
    """A run of windows as one number: its first window, and the largest and smallest offset to its suffix."""
    return (ps << 24) | (hi << 12) | lo


def unpack(item):
    return item >> 24, (item >> 12) & 4095, item & 4095


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prints:
    """Fingerprints of any range of some bytes: prefix sums of mixed 8-byte words times powers of an odd base."""

    up = down = None

    def __init__(self, data: np.ndarray):
        if Prints.up is None:
            base = 0x9E3779B97F4A7C15
            for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
                powers = np.full(PIECE + MARGIN, factor, np.uint64)
                powers[0] = 1
                setattr(Prints, name, np.cumprod(powers, dtype=np.uint64))
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        words = np.ndarray((len(data),), "<u8", padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_mix(words + U(0x632BE59BD9B4E019)) * Prints.up[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of bytes [begin, end), eight at least."""
        return _mix((self.sums[end - 7] - self.sums[begin]) * Prints.down[begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        at = len(self.sums) - size
        return _mix((self.sums[size - 7:size - 7 + at] - self.sums[:at]) * Prints.down[:at])


def suffix_runs(prints: Prints, begin: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last window of each run, and its suffix. ``begin`` and ``windows`` are the texts' places and window counts."""
    width = window_count(length)
    keys = (prints.grams(min(GRAM, length - width + 1)) & ~U(0xFFFFFFFF))
    keys |= np.arange(len(keys), dtype=np.uint64)  # the first of equal hashes
    step = 1
    while step < width and len(keys) > step:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    at = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    suffix = (keys[at] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (suffix[1:] != suffix[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    return at[first], at[last], suffix[first]


def split_runs(q: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs cut where their offsets are multiples of ``size``: source row, offset block, new ``hi`` and ``lo``."""
    low, n = lo // size, hi // size - lo // size + 1
    source = np.repeat(np.arange(len(q)), n)
    block = low[source] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    return source, block, np.minimum(hi[source], block * size + size - 1), np.maximum(lo[source], block * size)


def entry_prints(prints: Prints, q, block, hi, lo, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``s`` and ``t`` of runs of windows with suffixes at ``q``; ``block`` is the offset divided by ``size``."""
    width = window_count(length)
    if size == 1:  # a window is all that it shares: its suffix's core and offset stand for s
        shared = prints.of(q, q + length - width + 1)
    else:
        shared = prints.of(q - block * size, q - block * size - size + 1 + length)
    covered = prints.of(q - hi, q - lo + length)
    return _mix(shared + block.astype(np.uint64) * U(0xD6E8FEB86659FD93)), _mix(covered + (hi * 4096 + lo).astype(np.uint64) * U(0xA0761D6478BD642F))


# --- logarithmic index family ----------------------------------------------------------------------------------


class Family:
    """Entries of the batches seen so far, in levels of falling size, each in fingerprint order.

    ``add`` merge-scans a batch against itself and every level. Entries found again are reported as repeats (in
    ``repeats``, the level's own entry the first time as well); others become a new level, and equal-sized levels merge.
    """

    COLUMNS = ("order", "s", "t", "text", "item", "n")

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []
        self.repeats: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(level["s"]) for level in self.levels)

    def _report(self, rows: dict[str, np.ndarray], which: np.ndarray) -> None:
        self.repeats.append((rows["text"][which], rows["item"][which]))

    def add(self, s: np.ndarray, t: np.ndarray, text: np.ndarray, item: np.ndarray, n: np.ndarray) -> None:
        order = _mix(s + t * U(0x9FB21C651E98DF25))
        by = np.argsort(order, kind="stable")
        new = dict(zip(self.COLUMNS, (x[by] for x in (order, s, t, text, item, n)), strict=True))
        same = np.zeros(len(by), bool)  # equal to the row before
        same[1:] = (new["s"][1:] == new["s"][:-1]) & (new["t"][1:] == new["t"][:-1])
        grouped = same.copy()
        grouped[:-1] |= same[1:]
        self._report(new, grouped & (new["n"] == 1))
        new["n"][grouped] = 2
        keep = ~same
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["order"], new["order"]), len(level["s"]) - 1)
            found = keep & (level["s"][at] == new["s"]) & (level["t"][at] == new["t"])
            self._report(new, found & (new["n"] == 1))
            hit = np.unique(at[found])
            self._report(level, hit[level["n"][hit] == 1])
            level["n"][hit] = 2
            keep &= ~found
        if keep.any():
            self.levels.append({c: x[keep] for c, x in new.items()})
        while len(self.levels) > 1 and 2 * len(self.levels[-1]["s"]) > len(self.levels[-2]["s"]):
            upper, lower = self.levels.pop(), self.levels.pop()
            both = {c: np.concatenate((lower[c], upper[c])) for c in self.COLUMNS}
            by = np.argsort(both["order"], kind="stable")  # two sorted runs: a merge
            self.levels.append({c: x[by] for c, x in both.items()})

    def rows(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries still open, and repeats as rows of ``n`` 0 whose ``s`` only spreads them."""
        names = [x.split()[0] for x in ROW.split(", ")]
        if self.repeats:
            text, item = (np.concatenate(x) for x in zip(*self.repeats, strict=True))
            by = np.lexsort((item, text))
            text, item = text[by], item[by]
            once = np.ones(len(text), bool)
            once[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
            text, item = text[once], item[once]
            spread = _mix(keys[text, 0].view(np.uint64) + item.view(np.uint64))
            yield from _record_batches(names, [spread.view(np.int64), np.zeros(len(text), np.int64), keys[text, 0], keys[text, 1], item,
                                               np.zeros(len(text), np.int32)])
        for level in self.levels:
            yield from _record_batches(names, [level["s"].view(np.int64), level["t"].view(np.int64), keys[level["text"], 0],
                                               keys[level["text"], 1], level["item"], level["n"].astype(np.int32)])


def _record_batches(names: list[str], columns: list[np.ndarray], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a:a + size])) for c in columns], names)


# --- tasks ----------------------------------------------------------------------------------------------------


def _pieces(texts: list[bytes], first_row: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes of several texts, or a part of a long one, with text number, place, offset and window count of each.

    Long texts are cut at the same windows in every step, so that runs of windows never cross a cut.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        windows = len(text) - length + 1
        for a in range(0, max(windows, 0), PIECE):
            n = min(PIECE, windows - a)
            if held and size + n + length > PIECE:
                yield _piece(held)
                held, size = [], 0
            held.append((text[a:a + n + length - 1], first_row + row, a, n))
            size += n + length - 1
    if held:
        yield _piece(held)


def _piece(held: list[tuple]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(h[0]) for h in held])
    return (np.frombuffer(b"".join(h[0] for h in held), np.uint8), np.array([h[1] for h in held]), np.cumsum(sizes) - sizes,
            np.array([h[2] for h in held]), np.array([h[3] for h in held]))


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def entries(length: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``text, k1, k2[, items]`` to the open entries and repeats of a task; ``items`` are the runs to go on with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, keys, count = Family(), [], 0
        for batch in batches:
            texts = _text_bytes(batch.column(0))
            keys.append(np.stack([batch.column(i).to_numpy(False) for i in (1, 2)], axis=1))
            todo = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            for data, owner, place, offset, windows in _pieces(texts, count, length):
                prints = Prints(data)
                if todo is None:
                    first, last, q = suffix_runs(prints, place, windows, length)
                    part = np.searchsorted(place, first, "right") - 1
                    hi, lo, block, n = q - first, q - last, np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
                else:
                    given = [np.array([(i["item"], i["state"]) for i in todo[o - count]], np.int64).reshape(-1, 2) for o in owner]
                    given = [g[((g[:, 0] >> 24) >= a) & ((g[:, 0] >> 24) < a + w)] for g, a, w in zip(given, offset, windows, strict=True)]
                    part = np.repeat(np.arange(len(given)), [len(g) for g in given])
                    given = np.concatenate(given)
                    ps, hi, lo = unpack(given[:, 0])
                    q = ps - offset[part] + place[part] + hi
                    source, block, hi, lo = split_runs(q, hi, lo, size)
                    q, part, n = q[source], part[source], given[source, 1]
                s, t = entry_prints(prints, q, block, hi, lo, size, length)
                item = pack(q - hi - place[part] + offset[part], hi, lo)
                for a in range(0, len(q), BATCH):
                    cut = slice(a, a + BATCH)
                    family.add(s[cut], t[cut], owner[part[cut]], item[cut], n[cut])
                if len(family) >= FLUSH:
                    yield from family.rows(np.concatenate(keys))
                    family = Family()
            count += len(texts)
        if count:
            yield from family.rows(np.concatenate(keys))

    return run


def merge_scan(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of all families in the order of (s, t) to spans, undecided entries and witnesses.

    Only the rows of the last (s, t) are held over: one a task at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, same_before = None, False

        def decide(rows: list[np.ndarray], before: bool, end: bool):
            """All groups but the last one, or all at the end; then what is held over."""
            s, t, k1, k2, item, n = rows
            new_s, new = np.ones(len(s), bool), np.ones(len(s), bool)
            new_s[1:] = s[1:] != s[:-1]
            new[1:] = new_s[1:] | (t[1:] != t[:-1])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            total = np.add.reduceat(n, starts)
            after = np.append(~new_s[starts[1:]], False)  # the next group has the same s
            behind = np.concatenate(([before], after[:-1]))
            shared = (after | behind)[group]
            state = np.full(len(s), -1, np.int32)
            state[(n == 1) & (total[group] == 1) & shared] = UNDECIDED
            state[(n == 1) & (total[group] >= 2)] = SPAN
            state[n == 0] = SPAN
            stop = len(s) if end else starts[-1]
            out = [(k1[:stop], k2[:stop], item[:stop], state[:stop])]
            witness = starts[(total >= 2) & (after | behind) & (starts < stop)]
            out.append((k1[witness], k2[witness], item[witness], np.full(len(witness), WITNESS, np.int32)))
            keep = [np.concatenate(x) for x in zip(*out, strict=True)]
            chosen = (keep[3] == SPAN) if last else (keep[3] >= 0)
            return [x[chosen] for x in keep], [x[stop:] for x in rows], bool(behind[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(False) for i in range(6)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            done, held, same_before = decide(rows, same_before, False)
            yield from _record_batches(["k1", "k2", "item", "state"], done)
        if held is not None:
            yield from _record_batches(["k1", "k2", "item", "state"], decide(held, same_before, True)[0])

    return run


# --- all texts ------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_k1", F.xxhash64("_text")).withColumn("_k2", F.xxhash64(F.lit(11), "_text"))


def repeated_runs(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> list[DataFrame]:
    """Per step, stored rows ``k1, k2, item, state``: runs of windows of a text (known by two hashes) that repeat, and open ones."""
    width = window_count(length)
    texts = _keyed(docs, text_col).filter(F.octet_length("_text") >= length).select("_text", "_k1", "_k2")
    found, sizes = [], [width, max(1, width // 8), 1]
    for step, size in enumerate(sizes):
        given = texts
        if found:
            todo = (found[-1].filter(F.col("state") != SPAN).groupBy("k1", "k2")
                    .agg(F.collect_set(F.struct("item", "state")).alias("items")))
            # equal texts have witnesses only, and one of them is enough; a group of copies is one row a task
            given = texts.dropDuplicates(["_k1", "_k2"]).join(
                todo, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select("_text", "_k1", "_k2", "items")
        merged = (given.mapInArrow(entries(length, size), ROW).repartition("s").sortWithinPartitions("s", "t")
                  .mapInArrow(merge_scan(step == len(sizes) - 1), FOUND))
        found.append(stored(merged, f"suffix-runs-{size}"))
    return found


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans, kept = [], []
            for text, items in zip(_text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if not items:
                    spans.append([])
                    kept.append(text)
                    continue
                ps, hi, lo = unpack(np.array(sorted(items), np.int64))
                reach = np.maximum.accumulate(ps + hi - lo + length)
                new = np.ones(len(ps), bool)
                new[1:] = ps[1:] > reach[:-1]
                begin, end = ps[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(ps) - 1)]
                spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                edges = [0, *np.stack((begin, end), axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())],
                                             ["id", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row ``id_col, n_bytes, spans`` (removed runs of bytes, ``begin`` to ``end``) and ``kept`` (the bytes that stay)."""
    runs = [f.filter(F.col("state") == SPAN).select("k1", "k2", "item") for f in repeated_runs(docs, text_col, length)]
    by_text = runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    rows = _keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")), "body")
    joined = rows.join(by_text, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select("id", "_text", "items")
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = joined.mapInArrow(_cut(length), f"id {id_type}, spans array<struct<begin:bigint,end:bigint>>, kept binary")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"])
    return cut.select(F.col("id").alias(id_col), (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), "spans", "kept")
