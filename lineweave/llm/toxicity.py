"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

1. Clues. Words and their first four and five bytes are counted in hashed buckets over all labelled texts
   of either class; buckets that lean to toxic texts are looked at closely: the distinct words before a clue
   are counted, so that a clue that one copied passage repeats has one context. Clues with enough
   contexts and a high log-odds make the lexicon.
2. Labelled tokens. In toxic texts tokens with a clue are inside a span; all other tokens are outside.
3. The field. A chain is a sentence or line (at most ``CHAIN`` tokens). Emissions are linear in the clues of a
   token and of its neighbours; two states, four transitions. It is fitted by gradients of the likelihood
   (forward-backward) on at most ``SENTENCES`` sentences of each kind, those first by hash.
4. Scores. The marginals of a text (the largest, and their sum) go into a logistic curve fitted on at most
   ``SAMPLE`` labelled texts. Runs of tokens with a marginal of one half or more are the offending spans.

Scoring covers whole texts of all documents, in tasks, with a model of bounded size (``LEXICON`` clues).

Defined results: null counts as empty; a text without words has marginal zero and the score that goes with
it; a label of null is no label; without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.session import stored

BUCKETS = 1 << 18
LEXICON, SENTENCES, SAMPLE = 20_000, 4_000, 10_000
MIN_CONTEXTS, MIN_ODDS, TOXIC_SCORE = 5, 3.0, 0.7
CHAIN = 256
PREFIXES = (4, 5)
FEATURES = 2 + len(PREFIXES) + 2  # clues, any clue, the neighbours' clues
U = np.uint64
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 63]] = True


@dataclass
class Tokens:
    """Words of a batch of texts: clue hashes (word, prefixes), bytes, the first word of each text, the chain of each word."""
    clues: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    chain: np.ndarray
    data: np.ndarray


def read(column: pa.Array) -> Tokens:
    data, offsets = wh.text_buffers(column)
    word, begin, end, first = wh.words(data, offsets)
    clues = [word] + [wh.run_hashes(data, begin, np.minimum(begin + n, end)) ^ U(n * 0x9E3779B9) for n in PREFIXES]
    stops = np.cumsum(STOPS[data])[begin] if len(begin) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(begin), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    nth = np.arange(len(begin)) - np.repeat(heads, np.diff(np.append(heads, len(begin))))
    new |= nth % CHAIN == 0
    return Tokens(np.stack(clues), begin, end, first, np.cumsum(new) - 1, data)


@dataclass
class Model:
    clues: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    emission: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def features(self, t: Tokens) -> np.ndarray:
        n = t.clues.shape[1]
        out = np.zeros((n, FEATURES), np.float32)
        if not len(self.clues) or not n:
            return out
        for i, h in enumerate(t.clues):
            at = np.minimum(np.searchsorted(self.clues, h), len(self.clues) - 1)
            out[:, i] = np.where(self.clues[at] == h, self.odds[at], 0)
        most = out[:, :len(t.clues)].max(axis=1)
        out[:, len(t.clues)] = most > 0
        same = t.chain[1:] == t.chain[:-1]
        out[1:, -2] = most[:-1] * same
        out[:-1, -1] = most[1:] * same
        return out


def padded(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens in a matrix of chains, longest first: row, column and length of each row."""
    length = np.bincount(chain) if len(chain) else np.zeros(0, np.int64)
    order = np.argsort(-length, kind="stable")
    row = np.empty(len(length), np.int64)
    row[order] = np.arange(len(length))
    head = np.concatenate(([0], np.cumsum(length)))[:-1]
    return row[chain], np.arange(len(chain)) - head[chain], length[order]


def forward_backward(score: np.ndarray, chain: np.ndarray, transition: np.ndarray):
    """Marginals of state 1, expected transitions summed over all chains, and the log of all partition sums.

    ``score``: emission of state 1 over state 0 of each token. Chains go side by side, one column a step.
    """
    row, column, length = padded(chain)
    width = int(length[0]) if len(length) else 0
    e1 = np.zeros((width, len(length)))
    e1[column, row] = np.exp(np.clip(score, -30, 30))
    move = np.exp(transition)
    alive = [int(np.searchsorted(-length, -c, "left")) for c in range(width)]  # chains longer than c
    a0, a1 = np.zeros((width, len(length))), np.zeros((width, len(length)))
    total = 0.0
    for c in range(width):
        k = alive[c]
        if c:
            p0, p1 = a0[c - 1, :k], a1[c - 1, :k]
            n0, n1 = p0 * move[0, 0] + p1 * move[1, 0], (p0 * move[0, 1] + p1 * move[1, 1]) * e1[c, :k]
        else:
            n0, n1 = np.ones(k), e1[0, :k]
        z = n0 + n1
        total += np.log(z).sum()
        a0[c, :k], a1[c, :k] = n0 / z, n1 / z
    marginal, moves = np.zeros((width, len(length))), np.zeros((2, 2))
    b0, b1 = np.ones(len(length)), np.ones(len(length))
    for c in range(width - 1, -1, -1):
        k = alive[c]
        m0, m1 = a0[c, :k] * b0[:k], a1[c, :k] * b1[:k]
        marginal[c, :k] = m1 / (m0 + m1)
        if c:
            f0, f1 = b0[:k], b1[:k] * e1[c, :k]
            p0, p1 = a0[c - 1, :k], a1[c - 1, :k]
            joint = np.array([[p0 * move[0, 0] * f0, p0 * move[0, 1] * f1], [p1 * move[1, 0] * f0, p1 * move[1, 1] * f1]])
            moves += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
            n0, n1 = move[0, 0] * f0 + move[0, 1] * f1, move[1, 0] * f0 + move[1, 1] * f1
            z = n0 + n1
            b0[:k], b1[:k] = n0 / z, n1 / z
    return marginal[column, row], moves, total


def fit_field(x: np.ndarray, y: np.ndarray, chain: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (bias last) and transitions of the largest penalised likelihood, by Adam."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    same = chain[1:] == chain[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    theta, m, s, n = np.zeros(x.shape[1] + 4), 0.0, 0.0, max(1, len(x))
    theta[x.shape[1] - 1] = -2.0
    for t in range(1, steps + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, moves, _ = forward_backward(x @ w, chain, move)
        grad = np.concatenate([x.T @ (y - marginal), (seen - moves).ravel()]) / n - 1e-4 * theta
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def marginals(model: Model, t: Tokens) -> np.ndarray:
    """Of each word; chains without any clue differ in their length alone, so one of each length is worked out."""
    if not len(t.chain):
        return np.zeros(0)
    x = model.features(t)
    score = x @ model.emission[:-1] + model.emission[-1]
    length = np.bincount(t.chain)
    busy = np.zeros(len(length), bool)
    busy[t.chain[x[:, FEATURES - 3] > 0]] = True
    out = np.zeros(len(score))
    at = np.flatnonzero(busy[t.chain])
    if len(at):
        out[at], _, _ = forward_backward(score[at], np.unique(t.chain[at], return_inverse=True)[1], model.transition)
    plain = np.flatnonzero(~busy[t.chain])
    if len(plain):
        sizes = np.unique(length[~busy])
        kinds = np.repeat(np.arange(len(sizes)), sizes)
        bare, _, _ = forward_backward(np.full(len(kinds), model.emission[-1]), kinds, model.transition)
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        head = np.concatenate(([0], np.cumsum(length)))[:-1]
        out[plain] = bare[start[np.searchsorted(sizes, length[t.chain[plain]])] + plain - head[t.chain[plain]]]
    return out


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: largest marginal, and the sum of those that are at least a tenth on a log scale."""
    out = np.zeros((len(first) - 1, 2))
    strong = np.where(p >= 0.1, p, 0)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled, 0] = np.maximum.reduceat(p, first[filled])
        out[filled, 1] = np.log1p(np.add.reduceat(strong, first[filled]))
    return out


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in wh.slices(batch, "text"):
            t, label = read(part.column("text")), part.column("label").to_numpy()
            text = np.repeat(np.arange(len(label)), np.diff(t.first))
            for h in t.clues:  # each bucket once a text
                seen = np.unique(text * BUCKETS + (h % U(BUCKETS)).astype(np.int64))
                for y in (0, 1):
                    counts[y] += np.bincount(seen[label[seen // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "n0", "n1"])


def log_odds(n1, n0, total1, total0):
    return np.log((n1 + 0.5) / (total1 + 1)) - np.log((n0 + 0.5) / (total0 + 1))


def find_clues(texts: DataFrame, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon (sorted hashes, log-odds) from all labelled ``texts`` (``text, label``)."""
    buckets = (texts.mapInArrow(_bucket_counts, "bucket bigint, n0 bigint, n1 bigint")
               .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
               .filter(F.col("n1") >= MIN_CONTEXTS)).toArrow()  # at most BUCKETS rows
    odds = log_odds(buckets["n1"].to_numpy(), buckets["n0"].to_numpy(), n1, n0)
    leaning = np.zeros(BUCKETS, bool)
    leaning[buckets["bucket"].to_numpy()[odds >= MIN_ODDS / 2]] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(leaning))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in wh.slices(batch, "text"):
                t, label = read(part.column("text")), part.column("label").to_numpy()
                y = np.repeat(label, np.diff(t.first))
                before = np.zeros(t.clues.shape[1], np.uint64)
                before[1:] = t.clues[0, :-1]
                before[t.first[:-1][np.diff(t.first) > 0]] = 0
                rows = [np.stack([h[k], before[k], y[k].astype(np.uint64)])
                        for h in t.clues for k in [np.flatnonzero(near[(h % U(BUCKETS)).astype(np.int64)])]]
                rows = np.unique(np.concatenate(rows, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)) for r in rows], ["clue", "before", "label"])

    found = (texts.mapInArrow(contexts, "clue bigint, before bigint, label bigint").distinct()
             .groupBy("clue").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"))
             .filter(F.col("c1") >= MIN_CONTEXTS)
             .withColumn("odds", F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1)))
             .filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc(F.col("odds") * F.log("c1")), "clue").limit(LEXICON)).toArrow()
    clue = found["clue"].to_numpy().view(np.uint64)
    order = np.argsort(clue)
    return clue[order], np.minimum(found["odds"].to_numpy()[order], 6.0)


def _sentences(model: Model):
    """Sentences of labelled texts with their tokens' features: kind 1 with tokens inside a span, 0 without.

    A task keeps, of each kind, those that are first by hash, and returns them when it is through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bar = ([], []), [2 ** 64, 2 ** 64]

        def trim(kind: int) -> None:
            held[kind].sort(key=lambda row: row[0])
            del held[kind][SENTENCES:]
            if len(held[kind]) == SENTENCES:
                bar[kind] = held[kind][-1][0]

        for batch in batches:
            for part in wh.slices(batch, "text"):
                t, label = read(part.column("text")), part.column("label").to_numpy()
                if not len(t.chain):
                    continue
                x = model.features(t)
                y = (np.repeat(label, np.diff(t.first)) * (x[:, FEATURES - 3] > 0)).astype(np.int8)
                head = np.flatnonzero(np.concatenate(([True], np.diff(t.chain) > 0)))
                tail = np.append(head[1:], len(y))
                kind = np.maximum.reduceat(y, head)
                key = wh.mix(np.add.reduceat(wh.mix(t.clues[0]), head))
                for k in (0, 1):
                    for i in np.flatnonzero((kind == k) & (key <= U(min(bar[k], 2 ** 64 - 1)))):
                        held[k].append((int(key[i]), x[head[i]:tail[i]].tobytes(), y[head[i]:tail[i]].tobytes()))
                    if len(held[k]) > 2 * SENTENCES:
                        trim(k)
        for k in (0, 1):
            trim(k)
        rows = [(k, *row) for k in (0, 1) for row in held[k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["kind", "key", "x", "y"])
    return run


def first_by_key(rows: DataFrame, n: int) -> list[Row]:
    """The ``n`` rows with the smallest keys (64 bits without a sign). The driver gets few more than those.

    The bar is found first, from counts by the leading bits of the keys, 16 bits at a time.
    """
    part, wanted, bar = rows, n, None
    for shift in (48, 32, 16, 0):
        leading = F.shiftrightunsigned("key", shift)
        counts = sorted((r["b"], r["count"]) for r in part.groupBy(leading.alias("b")).count().collect())  # 65,536 rows at most
        total = 0
        for b, count in counts:
            total += count
            if total >= wanted:
                break
        else:  # all of them
            break
        bar = leading <= b
        if total <= 2 * n:
            break
        wanted, part = wanted - total + count, part.filter(leading == b)
    found = rows.filter(bar).collect() if bar is not None else rows.collect()
    return sorted(found, key=lambda r: (r["key"] % 2 ** 64, bytes(r["x"])))[:n]


def train(texts: DataFrame) -> Model:
    """``texts``: ``id, text, label`` of the rows that may be learned from."""
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    model = Model()
    if not n0 or not n1:
        return model
    model.clues, model.odds = find_clues(texts, n0, n1)
    if not len(model.clues):
        return model
    rows = stored(texts.mapInArrow(_sentences(model), "kind bigint, key bigint, x binary, y binary"), "sentences")
    chosen = [r for k in (0, 1) for r in first_by_key(rows.filter(F.col("kind") == k), SENTENCES)]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in chosen]).astype(np.float64)
    y = np.concatenate([np.frombuffer(r["y"], np.int8) for r in chosen]).astype(np.int64)
    chain = np.repeat(np.arange(len(chosen)), [len(r["y"]) for r in chosen])
    model.emission, model.transition = fit_field(x, y, chain)

    sample = texts.orderBy(F.xxhash64("id"), "id", "label").select("id", "label").limit(SAMPLE).distinct()
    known = texts.join(F.broadcast(sample), ["id", "label"])  # at most SAMPLE rows of two numbers
    got = known.mapInArrow(_summaries(model), "label int, most double, total double").toArrow()
    z = np.stack([np.ones(got.num_rows), got["most"].to_numpy(), got["total"].to_numpy()], 1)
    model.curve = logistic(z, got["label"].to_numpy().astype(float))
    return model


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return w


def _summaries(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                t = read(part.column("text"))
                s = summary(marginals(model, t), t.first)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(s[:, 0]), pa.array(s[:, 1])], ["label", "most", "total"])
    return run


SPANS = "array<struct<begin:int,end:int,probability:double>>"


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            for part in wh.slices(batch, "text"):
                t = read(part.column("text"))
                p = marginals(model, t)
                s = summary(p, t.first)
                score = 1 / (1 + np.exp(-np.clip(model.curve[0] + s @ model.curve[1:], -40, 40)))
                spans = [[] for _ in range(part.num_rows)]
                inside = np.flatnonzero(p >= 0.5)
                if len(inside):
                    text = np.searchsorted(t.first, inside, "right") - 1
                    # characters before each byte, counted from the start of its text
                    chars = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
                    offsets = wh.text_buffers(part.column("text"))[1]
                    new = np.concatenate(([True], (np.diff(inside) > 1) | (np.diff(text) > 0) | (np.diff(t.chain[inside]) > 0)))
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(inside)) - 1
                    for a, b in zip(head, tail, strict=True):
                        zero = chars[offsets[text[a]]]
                        spans[text[a]].append({"begin": int(chars[t.begin[inside[a]]] - zero), "end": int(chars[t.end[inside[b]]] - zero),
                                               "probability": float(p[inside[a:b + 1]].max())})
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(spans, kind)], ["id", "score", "spans"])
    return run


def toxic_spans(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, spans`` (character offsets). ``labelled`` has ``id, label`` of the rows that may be learned from."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = labelled.filter("id is not null and label in (0, 1)").select("id", F.col("label").cast("int").alias("label")).distinct()
    # one plan at every size: labels grow with the corpus
    model = train(stored(texts.join(known.hint("merge"), "id"), "labelled-texts"))
    return texts.mapInArrow(_scores(model), f"id bigint, score double, spans {SPANS}").withColumnRenamed("id", id_col)
