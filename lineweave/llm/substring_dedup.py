"""Substring dedup: near-duplicate passages by compact windows over token min-hashes.

Tokens are five-word shingles. For a hash function, the Cartesian tree of a text's token hashes has a node c
with the range [l, r] in which c is the least; all passages from [l, c] to [c, r] have c's hash as their
min-hash. Such a compact window (l, c, r) stands for all of them; only windows that hold a passage of
``MIN_WORDS`` words are kept, about 2 n / t a text.

1. Windows of ``FUNCTIONS`` hash functions give keys; keys of one text alone are dropped.
2. In each text, windows of two functions are joined where a passage of the least length lies in both
   (an interval join): passages with two signatures that other texts have, too. So a passage is looked at where at least two of
   ``FUNCTIONS`` min-hashes are shared: all exact repeats, and 97 of 100 at a similarity of 0.8, more above.
   Joined windows that overlap are one range.
   Of the tokens in ranges three of eight, the same in all texts, are counted first. Parts where more of these are in no other text than a
   similar passage may lack go no further; what is not counted yet is taken as shared, so that no part is lost that has a prefix token.
3. The texts that hold a token in such parts are counted. With tokens ordered from rare to frequent, the rarest token that two
   similar passages share is among the first fifth (and one more) of both. These prefix tokens (``RUNGS``) are the keys of
   groups, so that a frequent phrase that texts share without a passage around it is no key.
4. In a group, leaders are compared with the others (``linking.link_by_leaders``): no pairs among the
   members that a leader covers. Each pair is verified over both whole texts: passages with a
   Jaccard similarity of their shingles of at least ``SIMILARITY``, both of ``MIN_WORDS`` words or more.
5. Verified passages of one text that overlap are one region; regions that links join are a class.

Equal texts are one node; each of them gets its rows. A text of enough words that several ids hold has a row
of kind ``text`` as well, whose class are its copies.

Defined results: null and empty texts, and texts under ``MIN_WORDS`` words, have no rows; a row with a null id has
none; rows that repeat an id with an equal text are one document; an id with several texts has the rows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.llm.linking import components, link_by_leaders, stored_alone as stored

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
FUNCTIONS = 4
MERGE_OVERLAP = 25  # words that two passages of a text must share to be one region
LEAST = MIN_WORDS - SHINGLE + 1
SAMPLED = 3 * 2 ** 61  # tokens whose mixed hash is below are counted first: three of eight
COUNT_BITS = 8  # of a token that give way to its count, as the eighth of a logarithm
U = np.uint64


def token_hashes(shingle: np.ndarray, function: int) -> np.ndarray:
    """Never 0, which marks windows that leave a text."""
    return wh.mix(shingle + U((function + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) | U(1)


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Least or greatest of each ``size`` consecutive values, by doubling."""
    out, width = values, 1
    while width < size:
        step = min(width, size - width)
        out = best(out[:-step], out[step:])
        width += step
    return out


def window_minima(hashes: np.ndarray, start: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Places that are the least of some ``least`` consecutive tokens of their text: those with a compact window."""
    if len(hashes) < least:
        return np.zeros(0, np.int64)
    low = _sliding(hashes, least, np.minimum)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    low = np.where(text[:len(low)] == text[least - 1:], low, U(0))
    edge = np.zeros(least - 1, np.uint64)
    high = _sliding(np.concatenate((edge, low, edge)), least, np.maximum)
    return np.flatnonzero(high == hashes)


def compact_windows(hashes: np.ndarray, start: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (l, c, r), inclusive, of all texts, by c, and the row of the first window of equal hash that this one lies in, or its own.

    One pass over the minima gives the Cartesian trees' wide nodes. Of equal hashes the first counts as the least.
    Whatever bounds a minimum's range is a minimum itself, as its own range is wider.
    """
    places = window_minima(hashes, start, least)
    text = np.searchsorted(start, places, "right") - 1
    begin, end = start[text].tolist(), (start[text + 1] - 1).tolist()
    left, right, stack = list(begin), list(end), []
    values, at, head = hashes[places].tolist(), places.tolist(), list(range(len(places)))
    for i, value in enumerate(values):
        if stack and begin[stack[-1]] != begin[i]:
            stack.clear()
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
            if values[stack[-1]] == value:
                head[i] = head[stack[-1]]
        stack.append(i)
    found = np.stack((np.array(left, np.int64), places, np.array(right, np.int64), np.array(head, np.int64)), 1)
    return found[found[:, 2] - found[:, 0] + 1 >= least]


def chains(windows: np.ndarray) -> np.ndarray:
    """Rows (l, first c, last c, r): windows of equal hash that lie in each other, as in texts that repeat themselves, are one."""
    head, first = np.unique(windows[:, 3], return_index=True)  # a first window is the widest, so it is there
    last = np.zeros(len(head), np.int64)
    np.maximum.at(last, np.searchsorted(head, windows[:, 3]), windows[:, 1])
    return np.stack((windows[first, 0], windows[first, 1], last, windows[first, 2]), 1)


def joined_windows(windows: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Ranges (begin, end) where windows of two functions have a common passage; ``windows``: chains by first c, a function.

    A passage with places of two chains lies in both. The first place of one chain is then in the range of the other.
    """
    found = [np.zeros((0, 2), np.int64)]
    for a in range(len(windows)):
        for b in range(a + 1, len(windows)):
            # the second way round finds more only for chains of several places
            for wa, wb in ((windows[a], windows[b]), (windows[b][windows[b][:, 2] > windows[b][:, 1]], windows[a])):
                low = np.searchsorted(wb[:, 1], wa[:, 0])
                n = np.searchsorted(wb[:, 1], wa[:, 3], "right") - low
                i = np.repeat(np.arange(len(wa)), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                left, right = np.maximum(wa[i, 0], wb[j, 0]), np.minimum(wa[i, 3], wb[j, 3])
                both = ((left <= np.minimum(wa[i, 2], wb[j, 2])) & (right >= np.maximum(wa[i, 1], wb[j, 1]))
                        & (right - left + 1 >= least))
                found.append(np.stack((left[both], right[both] + 1), 1))
    return np.concatenate(found)


def merged(ranges: np.ndarray) -> np.ndarray:
    """The union of ranges (begin, end) as ranges that do not overlap, in order."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.concatenate(([True], ranges[1:, 0] >= reach[:-1])))
    return np.stack((ranges[first, 0], reach[np.concatenate((first[1:], [len(ranges)])) - 1]), 1)


def prefix_rungs(least: int) -> list[tuple[int, int]]:
    """Lengths of parts, and the greatest length of the passages that each stands for.

    The rarest token that two similar passages share has at most ``1 - similarity`` of either's tokens before it. In a part of the
    passage around that token no more are before it, so that parts of a few lengths do for passages of ``least`` to twice as many.
    """
    rungs, low = [], least
    while low < 2 * least:
        high = min(2 * least, low + max(1, low // 6))
        rungs.append((low, high - 1))
        low = high
    return rungs


RUNGS = prefix_rungs(LEAST)


def stood_before(token: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The place where each token stood before in its text, or -1."""
    order = np.lexsort((token, node))
    same = (token[order][1:] == token[order][:-1]) & (node[order][1:] == node[order][:-1])
    before = np.full(len(token), -1)
    before[order[1:][same]] = order[:-1][same]
    return before


def again(before: np.ndarray, rungs: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that stood within reach before."""
    return (before >= 0) & (np.arange(len(before)) - before < rungs[-1][1])


def allowed(before: np.ndarray, place: np.ndarray, size: int, reach: int, similarity: float) -> np.ndarray:
    """For each part of ``size`` tokens: one more than the tokens of a passage of ``reach`` around it that a similar one may lack."""
    # a token is new in the parts that begin behind the place where it stood before
    n = len(place)
    distinct = np.cumsum(np.bincount(np.maximum(before + 1, place - size + 1).clip(0), minlength=n + 1)
                         - np.bincount(place + 1, minlength=n + 1))[:n - size + 1]
    return ((1 - similarity) * (distinct + reach - size) + 1e-9).astype(np.int64) + 1


def prefix_places(rank: np.ndarray, before: np.ndarray, cuts: np.ndarray, rungs: list[tuple[int, int]] = RUNGS,
                  similarity: float = SIMILARITY) -> np.ndarray:
    """Is a token one of the first of some part of its range? ``rank``: 0 for tokens of one text, else greater for more frequent tokens.

    ``before`` is the place where the token stood before, or -1. Passages are sets: a token that stood within reach counts as
    frequent for others, and a part of few distinct tokens has few first ones.
    """
    out = np.zeros(len(rank), bool)
    place = np.arange(len(rank))
    late = again(before, rungs)
    alone = np.concatenate(([0], np.cumsum((rank == 0) & ~late)))
    values, nth = np.unique(rank, return_inverse=True)
    nth = nth.astype(np.int32)  # numbers of half the size are parted several times as fast
    order = np.where(late, np.int32(len(values)), nth)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for size, reach in rungs:
        n = len(rank) - size + 1
        if n < 1:
            break
        first = allowed(before, place, size, reach, similarity)
        starts = np.flatnonzero((owner[:n] == owner[size - 1:]) & (alone[size:] - alone[:-size] < first))
        bar = np.full(n, -1, np.int32)
        views = np.lib.stride_tricks.sliding_window_view(order, size)
        for many in np.unique(first[starts]).tolist():
            alike = starts[first[starts] == many]
            for at in range(0, len(alike), 4096):
                some = alike[at:at + 4096]
                bar[some] = np.partition(views[some], many - 1, axis=1)[:, many - 1]
        edge = np.full(size - 1, -1, np.int32)
        out |= nth <= _sliding(np.concatenate((edge, bar, edge)), size, np.maximum)
    return out & (rank > 0)


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, _, _, first = wh.words(*wh.text_buffers(column))
    shingle, start = wh.shingles(hashes, first, SHINGLE)
    return shingle, start, np.diff(first)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists and where each list begins."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wh.slices(batch, "text"):
            shingle, start, n_words = _read(part.column("text"))
            keys, text = [], []
            for f in range(FUNCTIONS):
                h = token_hashes(shingle, f)
                at = window_minima(h, start)
                keys.append(h[at]), text.append(np.searchsorted(start, at, "right") - 1)
            key, owner = np.concatenate(keys), np.concatenate(text)
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            once = np.ones(len(key), bool)  # a hash that stands at several places of a text counts once
            once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            cut = np.searchsorted(owner[once], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(key[once].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sha"), pa.array(n_words), lists],
                                             ["id", "sha", "n_words", "keys"])


def sampled(token: np.ndarray) -> np.ndarray:
    """Is a token one of those that are counted first? The same in all texts."""
    return wh.mix(token) < U(SAMPLED)


def dense_parts(before: np.ndarray, alone: np.ndarray, cuts: np.ndarray, rungs: list[tuple[int, int]],
                similarity: float = SIMILARITY) -> np.ndarray:
    """Places in parts that a passage similar to one of another text may hold: of the part's tokens no more are ``alone`` than it may lack.

    ``alone`` may mark some of the tokens of one text only; marks that are missing keep more places. Parts and ``before`` as in
    ``prefix_places``, where such a part has no first tokens if it is not kept here.
    """
    n_all = len(alone)
    out = np.zeros(n_all, bool)
    place = np.arange(n_all)
    marks = np.concatenate(([0], np.cumsum(alone & ~again(before, rungs))))
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for size, reach in rungs:
        n = n_all - size + 1
        if n < 1:
            break
        some = allowed(before, place, size, reach, similarity)
        good = (owner[:n] == owner[size - 1:]) & (marks[size:] - marks[:-size] < some)
        edge = np.bincount(np.flatnonzero(good), minlength=n_all + 1) - np.bincount(np.flatnonzero(good) + size, minlength=n_all + 1)
        out |= np.cumsum(edge)[:n_all] > 0
    return out


def _placed(ranges: np.ndarray) -> np.ndarray:
    """The places in ranges (begin, end), range after range."""
    n = ranges[:, 1] - ranges[:, 0]
    return np.arange(n.sum()) + np.repeat(ranges[:, 0] - np.cumsum(n) + n, n)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined windows whose hashes other texts have, too: ``bounds``, where each begins and ends; ``sample``: those tokens in them
    that are counted first, each once a text."""
    for batch in batches:
        for part in wh.slices(batch, "text"):
            shingle, start, _ = _read(part.column("text"))
            known = np.unique(_flat(part.column("shared"))[0]).view(np.uint64)
            windows = []
            for f in range(FUNCTIONS):
                h = token_hashes(shingle, f)
                w = compact_windows(h, start)
                windows.append(chains(w[np.isin(h[w[:, 1]], known)]))
            ranges = merged(joined_windows(windows))
            text = np.searchsorted(start, ranges[:, 0], "right") - 1
            place = _placed(ranges)
            place = place[sampled(shingle[place])]
            owner, token = np.searchsorted(start, place, "right") - 1, shingle[place]
            order = np.lexsort((token, owner))
            owner, token = owner[order], token[order]
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            count = np.arange(part.num_rows + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), _lists((ranges - start[text][:, None]).ravel(), 2 * np.searchsorted(text, count)),
                 _lists(token[once].view(np.int64), np.searchsorted(owner[once], count))], ["node", "bounds", "sample"])


def _dense_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the dense parts of ranges, and where each part ends: from ``node, text, bounds`` and, as ``held``, the sampled tokens
    that other texts hold."""
    for batch in batches:
        for part in wh.slices(batch, "text"):
            shingle, start, _ = _read(part.column("text"))
            bound, bound_start = _flat(part.column("bounds"))
            text = np.repeat(np.arange(part.num_rows), np.diff(bound_start))
            ranges = (bound + start[text]).reshape(-1, 2)
            place = _placed(ranges)
            token = shingle[place]
            node = np.searchsorted(start, place, "right") - 1
            cuts = np.concatenate(([0], np.cumsum(ranges[:, 1] - ranges[:, 0])))
            known = np.unique(_flat(part.column("held"))[0].view(np.uint64))
            alone = sampled(token)
            alone[alone] = ~np.isin(token[alone], known)
            dense = dense_parts(stood_before(token, node), alone, cuts, RUNGS)
            # runs of dense places, broken where a range ends
            begin, end, _ = wh.runs(dense, cuts)
            owner = node[begin]
            first = np.searchsorted(owner, np.arange(part.num_rows + 1))
            ends = np.cumsum(end - begin)
            at = np.concatenate(([0], ends))[first]
            lists = np.insert(ends - at[owner], first[:-1], 0)  # each text's cuts: 0 and the ends of its parts
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), _lists(token[dense].view(np.int64), at), _lists(lists, first + np.arange(len(first)))],
                ["node", "tokens", "cuts"])


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, id``: prefix tokens of texts, from ``node, tokens, cuts`` and, as ``held``, the tokens that several texts hold:
    above their lowest ``COUNT_BITS`` bits the token's, in these the logarithm of the number of texts."""
    for batch in batches:
        sizes = np.diff(_flat(batch.column("tokens"))[1])
        bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // 500_000, prepend=-1)) if len(sizes) else []
        for x, y in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
            part = batch.slice(int(x), int(y - x))
            token, start = _flat(part.column("tokens"))
            cut, cut_start = _flat(part.column("cuts"))
            held = np.unique(_flat(part.column("held"))[0].view(np.uint64))
            known, count = held >> U(COUNT_BITS), held & U(2 ** COUNT_BITS - 1)
            short = token.view(np.uint64) >> U(COUNT_BITS)
            at = np.minimum(np.searchsorted(known, short), len(known) - 1)
            rank = np.where(known[at] == short, (count[at] << U(64 - COUNT_BITS)) | short, U(0))
            node = np.repeat(np.arange(len(start) - 1), np.diff(start))
            # every list of cuts begins with 0 and ends with the length of its text's tokens
            cuts = np.unique(np.concatenate((cut + np.repeat(start[:-1], np.diff(cut_start)), start)))
            place = np.flatnonzero(prefix_places(rank, stood_before(token, node), cuts))
            ids = part.column("node").to_numpy(zero_copy_only=False)[node[place]]
            for low in range(0, len(place), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[place[low:low + 100_000]]), pa.array(ids[low:low + 100_000])], ["key", "id"])


def _stretches(mask: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Runs of shared tokens, joined over gaps while the whole stays similar (a gap counts on both sides)."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    out: list[list[int]] = []  # begin, end, shared, not shared
    for begin, end in runs:
        if out:
            last = out[-1]
            shared, gap = last[2] + end - begin, last[3] + begin - last[1]
            if shared >= similarity * (shared + 2 * gap):
                out[-1] = [last[0], end, shared, gap]
                # a long run may carry what was too far before
                while len(out) > 1:
                    one, two = out[-2], out[-1]
                    shared, gap = one[2] + two[2], one[3] + two[3] + two[0] - one[1]
                    if shared < similarity * (shared + 2 * gap):
                        break
                    out[-2:] = [[one[0], two[1], shared, gap]]
                continue
        out.append([begin, end, end - begin, 0])
    return [(b, e) for b, e, *_ in out]


def similar_passages(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY):
    """(begin, end) in ``a``, (begin, end) in ``b`` and the similarity of the passages that the token lists share.

    A pair of ranges is cut into the stretches that each shares with the other, all of them with all, until a pair
    is similar or shrinks no more. Both lists are treated alike.
    """
    out, work, seen = [], [(0, len(a), 0, len(b))], set()
    while work:
        begin, end, low, high = work.pop()
        one, two = np.isin(a[begin:end], b[low:high]), np.isin(b[low:high], a[begin:end])
        parts_a = [(begin + x, begin + y) for x, y in _stretches(one, similarity) if y - x >= least]
        parts_b = [(low + x, low + y) for x, y in _stretches(two, similarity) if y - x >= least]
        for part in ((*x, *y) for x in parts_a for y in parts_b):
            if part in seen:
                continue
            seen.add(part)
            own, other = np.unique(a[part[0]:part[1]]), np.unique(b[part[2]:part[3]])
            same = len(np.intersect1d(own, other, assume_unique=True))
            share = same / (len(own) + len(other) - same)
            if share >= similarity:
                out.append((*part, share))
            elif same:
                work.append(part)
    return sorted(out)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (half for whole in wh.slices(batch, "text_b") for half in wh.slices(whole, "text_a")):
            rows = []
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            sa, starta, _ = _read(part.column("text_a"))
            sb, startb, _ = _read(part.column("text_b"))
            for i in range(part.num_rows):
                for x, y, u, v, share in similar_passages(sa[starta[i]:starta[i + 1]], sb[startb[i]:startb[i + 1]]):
                    rows.append((a[i], b[i], x, y + SHINGLE - 1, u, v + SHINGLE - 1, share))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64() if n == 6 else pa.int64()) for n, c in enumerate(columns)],
                ["a", "b", "a_begin", "a_end", "b_begin", "b_end", "similarity"])


def held_by_several(rows: DataFrame, value: str) -> DataFrame:
    """The rows ``node, value`` whose value another node has, too. The rows are dealt once, for the count and for the join."""
    dealt = rows.repartition(value)
    several = dealt.groupBy(value).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select(value)
    return dealt.join(several.hint("shuffle_hash"), value, "left_semi")


def lists_of(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("node").agg(F.collect_list(value).alias(name))


LINK = "a bigint, b bigint, a_begin bigint, a_end bigint, b_begin bigint, b_end bigint, similarity double"


def passage_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between passages of texts (``node``, a number a text); the rows ``id, sha``; the texts ``sha, node, first, last, n_words``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text")).filter(
        "id is not null")
    keyed = base.mapInArrow(_window_keys, "id bigint, sha binary, n_words bigint, keys array<bigint>")
    texts = stored(keyed.groupBy("sha").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys"))
                   .withColumn("node", F.xxhash64("sha")), "texts")
    known = stored(lists_of(held_by_several(texts.select("node", F.explode("keys").alias("key")), "key"), "key", "shared")
                   .filter(F.size("shared") > 1), "shared-keys")
    several = texts.select(F.col("first").alias("id"), "sha", "node").join(known, "node")
    bodies = stored(base.join(several, ["id", "sha"]).dropDuplicates(["id", "sha"])
                    .select("node", "shared", "text"), "bodies")
    windows = stored(bodies.mapInArrow(
        _ranges, "node bigint, bounds array<bigint>, sample array<bigint>").filter("size(bounds) > 0"), "windows")
    sample = stored(lists_of(held_by_several(windows.select("node", F.explode("sample").alias("token")), "token"), "token", "held"),
                    "sampled-tokens")
    marked = windows.select("node", "bounds").join(sample, "node", "left").withColumn("held", F.coalesce("held", F.array().cast("array<bigint>")))
    ranges = stored(bodies.select("node", "text").join(marked, "node").mapInArrow(
        _dense_tokens, "node bigint, tokens array<bigint>, cuts array<bigint>").filter("size(tokens) > 0"), "ranges")
    places = ranges.select("node", F.explode(F.array_distinct("tokens")).alias("token"))
    common = places.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select(
        "token", F.least(F.lit(2 ** COUNT_BITS - 1), F.floor(8 * F.log2("n"))).cast("bigint").alias("level"))
    mark = F.col("token").bitwiseAND(F.lit(-2 ** COUNT_BITS)).bitwiseOR(F.col("level"))
    counts = stored(places.join(common, "token").select("node", mark.alias("mark")).groupBy("node").agg(F.collect_list("mark").alias("held")),
                    "counts")
    members = ranges.join(counts, "node").mapInArrow(_prefix_keys, "key bigint, id bigint")

    def verify(pairs: DataFrame) -> DataFrame:
        a = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_passages, LINK)

    links = link_by_leaders(members, verify)
    return links, base.select("id", "sha").distinct(), texts.drop("keys")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document and repeated passage: ``id_col, kind, start_word, end_word`` (exclusive), ``class_id``
    (the same for all documents with the passage), ``class_doc`` (smallest id of the class), ``n_docs``, ``similarity``
    (the best to another text)."""
    links, rows, texts = passage_links(docs, id_col, text_col)
    links = stored(links, "passage-links")
    sides = links.select(F.col("a").alias("node"), F.col("a_begin").alias("begin"), F.col("a_end").alias("end"), "similarity").unionByName(
        links.select(F.col("b").alias("node"), F.col("b_begin").alias("begin"), F.col("b_end").alias("end"), "similarity"))
    along = Window.partitionBy("node").orderBy("begin", F.desc("end"))
    spans = (sides.groupBy("node", "begin", "end").agg(F.max("similarity").alias("similarity"))
             .withColumn("reach", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("new", (F.col("reach").isNull() | (F.least("reach", "end") - F.col("begin") < MERGE_OVERLAP)).cast("int"))
             .withColumn("region", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    spans = stored(spans.withColumn("place", F.xxhash64("node", "region")), "passage-spans")
    a = spans.select(F.col("node").alias("a"), F.col("begin").alias("a_begin"), F.col("end").alias("a_end"), F.col("place").alias("x"))
    b = spans.select(F.col("node").alias("b"), F.col("begin").alias("b_begin"), F.col("end").alias("b_end"), F.col("place").alias("y"))
    edges = links.join(a, ["a", "a_begin", "a_end"]).join(b, ["b", "b_begin", "b_end"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    classes = components(edges)
    regions = (spans.groupBy("node", "place").agg(F.min("begin").alias("start_word"), F.max("end").alias("end_word"),
                                                   F.max("similarity").alias("similarity"))
               .join(classes, F.col("place") == F.col("id")).select("node", "start_word", "end_word", "similarity", "class_id"))
    passages = regions.join(texts.select("node", "sha"), "node").select("sha", F.lit("passage").alias("kind"), "start_word", "end_word",
                                                                         "similarity", "class_id")
    whole = texts.filter((F.col("last") > F.col("first")) & (F.col("n_words") >= MIN_WORDS)).select(
        "sha", F.lit("text").alias("kind"), F.lit(0).cast("bigint").alias("start_word"), F.col("n_words").alias("end_word"),
        F.lit(1.0).alias("similarity"), F.xxhash64(F.lit("text"), "sha").alias("class_id"))
    out = stored(rows.join(passages.unionByName(whole), "sha").select(
        F.col("id").alias(id_col), "kind", "start_word", "end_word", "class_id", "similarity"), "passage-rows")
    sizes = out.groupBy("class_id").agg(F.min(id_col).alias("class_doc"), F.count_distinct(id_col).alias("n_docs"))
    return out.join(sizes, "class_id").select(id_col, "kind", "start_word", "end_word", "class_id", "class_doc", "n_docs", "similarity")
