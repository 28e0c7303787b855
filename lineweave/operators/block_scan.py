"""Order-dependent rules over line tables: files of any length, in blocks of lines.

In a review a file is one row. Here a file is cut into blocks of ``BLOCK_LINES`` lines, which are shuffled by
(file, block), so that a file with half of all lines spreads like many files. Each rule runs in three steps:

1. a summary of each block says what the block does to whatever state it begins in; summaries compose;
2. a prefix scan over a file's summaries (small rows, in block order) gives the state each block begins in;
3. the rule's own fold, the same that a review runs on whole files, runs over the block from that state.

* RCU depth is clamped at zero: a block of sum s and clamped end t maps depth d to max(d + s, t), and the scan is a
  running sum and a running maximum.
* Locks: a block's summary is the last thing it did to each lock it touched. A lock's state before a block is that of
  the last block that touched it; the number of other locks held is a running sum of changes.
* Functions: a block's summary is how it ends if no function is open before it, and for an open one the record lows
  of the brace balance (or indent) that would close it, each with how the block ends from there.

Only lines that matter to a rule are kept. ``keys`` name a file; a null key is a file of its own kind. Line numbers
are unique inside a file; a null text matches nothing.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_from_hits
from ..functions.fixed_values import FUNCTION_MARKERS
from ..functions.text import contains_any, indent_of, trimmed
from ..session import stored
from . import block_rules, c_rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

BLOCK_LINES = 1024


def blocked(lines: DataFrame, *keys: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``keys, block, entries``: the kept lines of each block in order."""
    block = F.floor((F.col("line") - 1) / block_lines).cast("long")
    entries = F.array_sort(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), F.col("text")))).alias("entries")
    return lines.withColumn("block", block).groupBy(*keys, "block").agg(entries)


def _in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("block")


def _before(*keys: str) -> Window:
    return _in_order(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _joined(blocks: DataFrame, states: DataFrame, *keys: str) -> DataFrame:
    """Blocks with their states; keys may be null."""
    states = states.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "block")], *[c for c in states.columns if c not in (*keys, "block")])
    same = [blocks[c].eqNullSafe(states[f"_{c}"]) for c in (*keys, "block")]
    return blocks.join(states, same, "left").drop(*[f"_{c}" for c in (*keys, "block")])


# --- RCU ------------------------------------------------------------------------------------------------------


def rcu_findings(lines: DataFrame, *keys: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """RCU annotation findings of a line table ``keys, line, text`` of C sources."""
    blocks = stored(blocked(lines.filter(contains_any(F.col("text"), c_rules.RCU_WORDS)), *keys, block_lines=block_lines), "rcu-blocks")

    def change(e: Column) -> Column:
        return (F.contains(e["text"], F.lit("rcu_read_lock(")).cast("int")
                - F.contains(e["text"], F.lit("rcu_read_unlock(")).cast("int"))

    summary = blocks.select(
        *keys, "block", F.aggregate("entries", F.lit(0), lambda a, e: a + change(e)).cast("long").alias("s"),
        F.aggregate("entries", F.lit(0), lambda a, e: F.greatest(F.lit(0), a + change(e))).cast("long").alias("t"))
    total = F.sum("s").over(_in_order(*keys).rowsBetween(Window.unboundedPreceding, 0))
    running = summary.withColumn("total", total).withColumn("high", F.max(F.col("t") - F.col("total")).over(_before(*keys)))
    states = running.select(*keys, "block", (F.col("total") - F.col("s") + F.greatest(F.lit(0), F.coalesce("high", F.lit(0)))).cast(
        "int").alias("depth"))
    hits = _joined(blocks, states, *keys).select(*keys, c_rules.rcu_hits(F.col("entries"), F.col("depth")).alias("_hits"))
    return findings_from_hits(hits, "_hits", *keys)


# --- locks ----------------------------------------------------------------------------------------------------


def lock_findings(lines: DataFrame, *keys: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Returns and sleeps under a lock in a line table ``keys, line, text`` of C sources."""
    blocks = stored(blocked(lines.filter(contains_any(F.col("text"), c_rules.LOCK_WORDS)), *keys, block_lines=block_lines), "lock-blocks")

    def actions(e: Column, i: Column) -> Column:
        return F.array(F.struct((2 * i).alias("seq"), e["taken"].alias("name"), F.lit(True).alias("held"), e["spin"].alias("spin")),
                       F.struct((2 * i + 1).alias("seq"), e["dropped"].alias("name"), F.lit(False).alias("held"), F.lit(False).alias("spin")))

    done = F.filter(F.flatten(F.transform(c_rules.lock_events(F.col("entries")), actions)), lambda a: a["name"] != "")
    last = (blocks.select(*keys, "block", F.explode(done).alias("a"))
            .groupBy(*keys, "block", F.col("a.name").alias("name"))
            .agg(F.max_by(F.struct(F.col("a.held").alias("held"), F.col("a.spin").alias("spin")), F.col("a.seq")).alias("now"))
            .withColumn("was", F.lag("now").over(_in_order(*keys, "name"))))

    def count(held: Column) -> Column:
        return F.coalesce(held, F.lit(False)).cast("long")

    spins = {s: F.col(f"{s}.held") & F.col(f"{s}.spin") for s in ("now", "was")}
    changes = last.groupBy(*keys, "block").agg(
        F.sum(count(F.col("now.held")) - count(F.col("was.held"))).alias("more"),
        F.sum(count(spins["now"]) - count(spins["was"])).alias("more_spins"),
        F.collect_list(F.when(F.col("was.held"), F.struct("name", F.col("was.spin").alias("spin")))).alias("held"))
    every = _joined(blocks.select(*keys, "block"), changes, *keys)
    held = F.coalesce("held", F.array().cast(c_rules.HELD_TYPE))
    states = every.select(
        *keys, "block", held.alias("held"),
        (F.coalesce(F.sum("more").over(_before(*keys)), F.lit(0)) - F.size(held)).alias("others"),
        (F.coalesce(F.sum("more_spins").over(_before(*keys)), F.lit(0)) - F.size(F.filter(held, lambda h: h["spin"]))).alias("other_spins"))
    hits = _joined(blocks, states, *keys).select(*keys, c_rules.lock_hits(
        F.col("entries"), F.col("held"), F.col("others"), F.col("other_spins")).alias("_hits"))
    return findings_from_hits(hits, "_hits", *keys)


# --- functions ------------------------------------------------------------------------------------------------

CLOSED = {"start": 0, "depth": 0, "indent": 0}
NEVER = float("inf")


def span_summary(lines: list[dict], python: bool) -> dict:
    """What a block does to an open function, or to none.

    ``end``: how the block ends if no function is open before it. ``lows``: falling values at which a function that is
    open before it would close, with how the block ends from there. ``total``: the balance of its braces.
    """
    balance, values, bases = 0, [], []
    for x in lines:
        bases.append(x["indent"] if python else balance)
        balance += x["delta"]
        if python:
            values.append(NEVER if x["blank"] else x["indent"])
        else:
            values.append(balance if x["closes"] else NEVER)
    ends, lows = [CLOSED] * (len(lines) + 1), []  # lows: lines behind k whose value no line between them and k has reached
    for k in range(len(lines) - 1, -1, -1):
        x = lines[k]
        if x["marked"]:
            near = _nearest(lows, values, bases[k])
            ends[k] = ends[near + 1] if near is not None else {
                "start": x["line"], "depth": balance - bases[k] if not python else 0, "indent": x["indent"]}
        else:
            ends[k] = ends[k + 1]
        if values[k] < NEVER:
            while lows and values[lows[-1]] >= values[k]:
                lows.pop()
            lows.append(k)
    records, least = [], NEVER
    for k, value in enumerate(values):
        if value < least:
            least = value
            records.append({"value": value, **ends[k + 1]})
    return {"end": ends[0], "lows": records, "total": balance}


def _nearest(lows: list[int], values: list, base) -> int | None:
    """``lows`` has rising values up to its end, the nearest line: the nearest whose value is ``base`` at most."""
    low, high = 0, len(lows)
    while low < high:
        mid = (low + high) // 2
        if values[lows[mid]] <= base:
            low = mid + 1
        else:
            high = mid
    return lows[low - 1] if low else None


def after_block(state: dict, summary: dict, python: bool) -> dict:
    """The state behind a block that begins in ``state``."""
    if not state["start"]:
        return summary["end"]
    wanted = state["indent"] if python else -state["depth"]
    at = bisect_left(summary["lows"], -wanted, key=lambda r: -r["value"])
    if at < len(summary["lows"]):
        return {k: summary["lows"][at][k] for k in CLOSED}
    return {**state, "depth": 0 if python else state["depth"] + summary["total"]}


_STATE = pa.struct([(n, pa.int32()) for n in CLOSED])
_SUMMARY = (f"struct<end:{block_rules.OPEN_TYPE},lows:array<struct<value:int,start:int,depth:int,indent:int>>,total:int>")
_SUMMARY_ARROW = pa.struct([("end", _STATE), ("lows", pa.list_(pa.struct([("value", pa.int32()), *((n, pa.int32()) for n in CLOSED)]))),
                            ("total", pa.int32())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``keys..., block, python, lines`` to ``keys..., block, python, summary``."""
    for batch in batches:
        *kept, python, lines = batch.columns
        found = [span_summary(x, p) for x, p in zip(lines.to_pylist(), python.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*kept, python, pa.array(found, _SUMMARY_ARROW)], [*batch.schema.names[:-1], "summary"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by keys and block to ``keys..., block, opened``: the state before each block."""
    file, state = None, CLOSED
    for batch in batches:
        *kept, python, summary = batch.columns
        found = []
        for *key, p, s in zip(*(c.to_pylist() for c in kept[:-1]), python.to_pylist(), summary.to_pylist(), strict=True):
            if key != file:
                file, state = key, CLOSED
            found.append(state)
            state = after_block(state, s, p)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _STATE)], [*batch.schema.names[:-2], "opened"])


def long_function_findings(lines: DataFrame, *keys: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Functions that are too long in a line table ``keys, language, line, text``."""
    names = (*keys, "language")
    blocks = stored(blocked(lines.filter(F.col("language").isin(*FUNCTION_MARKERS)), *names, block_lines=block_lines), "span-blocks")
    language = F.col("language")

    def seen(e: Column) -> Column:
        text = trimmed(e["text"])
        return F.struct(e["line"].alias("line"), block_rules.opens_function(language, text).alias("marked"),
                        block_rules.brace_balance(text).cast("int").alias("delta"), F.contains(text, F.lit("}")).alias("closes"),
                        indent_of(e["text"]).cast("int").alias("indent"), (text == "").alias("blank"))

    told = F.filter(F.transform("entries", seen), lambda x: x["marked"] | x["closes"] | (x["delta"] != 0) | (
        (language == "python") & ~x["blank"]))
    rows = blocks.select(*names, "block", (language == "python").alias("python"), told.alias("lines"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    summaries = rows.mapInArrow(_summaries, f"{kept}, summary {_SUMMARY}")
    ordered = summaries.repartition(*names).sortWithinPartitions(*names, "block")  # one small row a block
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-2])
    states = ordered.mapInArrow(_scan, f"{kept}, opened {block_rules.OPEN_TYPE}")
    views = F.transform("entries", lambda e: F.struct(e["line"].alias("line"), e["text"].alias("text"), trimmed(e["text"]).alias("trim")))
    found = block_rules.spans_from(language, views, F.col("opened"))
    hits = _joined(blocks, states, *names).select(*names, block_rules.span_hits(found).alias("_hits"))
    return findings_from_hits(hits, "_hits", *keys)
