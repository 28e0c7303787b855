"""Quality classifier: random-indexing vectors, pooled per document, and a two-layer network.

Tokens are words and runs of punctuation, known by hash; a token that repeats the one before is the one token
"again". A token belongs to one of ``ROWS`` vector rows. A row's index vector has ``NONZERO`` entries of +1 or -1 at hashed places. A row's context vector is the
sum of the index vectors of all tokens within ``REACH`` places of its tokens, over all documents: tasks sum
their documents into one table of fixed size, Spark adds up the tables. Row vectors have length one.
A document is the mean of its tokens' row vectors beside the mean of its tokens' index vectors.

A two-layer numpy network is fitted on at most ``SAMPLE`` labelled documents (those first by hash of the
id), with its temperature on a fifth of them that takes no part in the fit, so that scores are calibrated
probabilities. Everything else covers all documents, whole texts.

Defined results: null counts as empty; a text without tokens has the zero vector and its score; a label
of null is no label; a document with several label rows counts for each; rows of one id are scored each by
their own text; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.session import stored

ROWS, WIDTH, NONZERO, REACH = 8192, 32, 4, 2
SAMPLE = 20_000
KEEP_SCORE = 0.3
HIDDEN, EPOCHS, BATCH, SEED = 32, 30, 256, 11
U = np.uint64
AGAIN = U(0x7F4A7C15)  # stands for a token that repeats the one before
PUNCTUATION = np.array([33 <= c < 127 and not wh.WORD_BYTES[c] for c in range(256)])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and punctuation runs in text order, and the first token of each text."""
    data, offsets = wh.text_buffers(column)
    word, mark = wh.WORD_BYTES[data].astype(bool), PUNCTUATION[data]
    parts = [wh.runs(m, offsets) for m in (word, mark)]
    begin = np.concatenate([p[0] for p in parts])
    hashes = np.concatenate([wh.run_hashes(data, p[0], p[1]) for p in parts])
    order = np.argsort(begin, kind="stable")
    hashes, first = hashes[order], np.searchsorted(begin[order], offsets)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[first < len(hashes)]] = False
    hashes[again] = AGAIN
    return hashes, first


def index_vectors() -> np.ndarray:
    """Sparse vectors of +1 and -1 from the hash of the row."""
    bits = wh.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * U(0x5851F42D4C957F2D))
    out = np.zeros((ROWS, WIDTH), np.float32)
    for i in range(NONZERO):
        at = ((bits >> U(8 * i)) % U(WIDTH)).astype(np.int64)
        out[np.arange(ROWS), at] += ((bits >> U(48 + i)) & U(1)).astype(np.float32) * 2 - 1
    return out


def rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U(ROWS)).astype(np.uint16)


def context_table(hashes: np.ndarray, first: np.ndarray, index: np.ndarray, table: np.ndarray) -> None:
    """Adds the index vectors of neighbours in the same text to the rows of each token; ``WIDTH x ROWS``."""
    n = len(hashes)
    if not n:
        return
    # texts stand REACH places apart, in a row of zeros
    gap = np.repeat(np.arange(len(first) - 1), np.diff(first)) * REACH
    row = np.full(n + gap[-1] + 2 * REACH, ROWS, np.int64)
    row[np.arange(n) + gap + REACH] = rows_of(hashes)
    middle = row[REACH:-REACH]
    for i in range(WIDTH):
        own = np.append(index[:, i], 0)[row]
        around = sum(own[REACH + k:len(own) - REACH + k] for k in range(-REACH, REACH + 1) if k)
        table[i] += np.bincount(middle, around, ROWS + 1)[:ROWS].astype(np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, index = np.zeros((WIDTH, ROWS), np.int64), index_vectors()
    for batch in batches:
        for part in wh.slices(batch, "text"):
            context_table(*tokens(part.column("text")), index, table)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(table[used, i]) for i in range(WIDTH)]],
                                     ["row", *[f"v{i}" for i in range(WIDTH)]])


def token_vectors(texts: DataFrame) -> np.ndarray:
    """Unit row vectors from all texts; at most ``ROWS`` rows come to the driver."""
    values = [f"v{i}" for i in range(WIDTH)]
    sums = texts.select("text").mapInArrow(_tables, "row int, " + ", ".join(f"{v} bigint" for v in values))
    table = np.zeros((ROWS, WIDTH))
    got = sums.groupBy("row").agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    table[got.column("row").to_numpy()] = np.stack([got.column(v).to_numpy() for v in values], 1)
    return row_vectors(table)


def row_vectors(table: np.ndarray) -> np.ndarray:
    """``ROWS x 2 WIDTH``: context vectors of length one beside index vectors."""
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return np.concatenate([unit.astype(np.float32), index_vectors()], axis=1)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """``n x 2 WIDTH``: the mean vector of the tokens of each text."""
    hashes, first = tokens(column)
    counts = np.diff(first)
    out = np.zeros((len(counts), vectors.shape[1]))
    row = rows_of(hashes)
    for i in np.flatnonzero(counts):
        for low in range(first[i], first[i + 1], wh.PIECE):
            out[i] += vectors[row[low:min(low + wh.PIECE, first[i + 1])]].sum(axis=0)
        out[i] /= counts[i]
    return out


class Network:
    """Two layers with a temperature; plain numpy, so that it is sent to tasks as it is."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden),
                  rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.rng = np.zeros(width), np.ones(width), 1.0, rng

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.w
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        m, s, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            order = self.rng.permutation(len(z))
            for i in range(0, len(z), BATCH):
                a, b = z[order[i:i + BATCH]], y[order[i:i + BATCH]]
                h = np.tanh(a @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]))) - b) / len(a)
                back = d[:, None] * self.w[2] * (1 - h * h)
                grads = [a.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
                t += 1
                for p, g, mm, ss in zip(self.w, grads, m, s, strict=True):  # Adam
                    mm += 0.1 * (g - mm)
                    ss += 0.001 * (g * g - ss)
                    p -= 0.01 * (mm / (1 - 0.9 ** t)) / (np.sqrt(ss / (1 - 0.999 ** t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss on rows that took no part in the fit."""
        raw = self.logits(x)
        def loss(t: float) -> float:
            p = 1 / (1 + np.exp(-np.clip(raw / t, -40, 40)))
            return -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-12))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)


def train(texts: DataFrame, labelled: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """``labelled``: ``id, label``; at most ``sample`` of its rows, those first by hash, are fitted."""
    chosen = stored(labelled.filter("id is not null and label is not null").orderBy(F.xxhash64("id"), "id", "label").limit(sample),
                    "quality-sample")
    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                x = pooled(part.column("text"), shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                    ["id", "label", "x"])

    rows = (texts.join(F.broadcast(chosen), "id").select("id", "label", "text")  # at most `sample` rows of two numbers
            .mapInArrow(features, "id bigint, label int, x array<float>").toArrow())
    network = Network(2 * WIDTH)
    if rows.num_rows:
        x = np.stack(rows.column("x").to_numpy(zero_copy_only=False)).astype(np.float64) if rows.num_rows else np.zeros((0, 2 * WIDTH))
        y, ids = rows.column("label").to_numpy().astype(float), rows.column("id").to_numpy()
        order = np.lexsort((y, ids))  # the same fit whatever the order of rows
        x, y = x[order], y[order]
        part = np.arange(len(y)) % 5 == 0
        network.fit(x[~part], y[~part]) if (~part).any() else None
        network.calibrate(x[part], y[part])
    else:
        network.w = [np.zeros_like(p) for p in network.w]
    return network


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string")) % folds


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> DataFrame:
    """``id_col, score``: probability of label 1. ``labelled`` has ``id, label`` of the rows that may be learned from."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    vectors = token_vectors(texts)
    scorer = text_scorer(texts, train(texts, labelled, vectors, sample), vectors)
    return texts.mapInArrow(scorer, "id bigint, score double").withColumnRenamed("id", id_col)


def text_scorer(texts: DataFrame, network: Network, vectors: np.ndarray) -> Callable:
    shared = texts.sparkSession.sparkContext.broadcast((network, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(text_scores(part, *shared.value))], ["id", "score"])
    return run


def text_scores(part: pa.RecordBatch, network: Network, vectors: np.ndarray) -> np.ndarray:
    return network.scores(pooled(part.column("text"), vectors))


def keep_good(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = KEEP_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    vectors = token_vectors(texts)
    shared = docs.sparkSession.sparkContext.broadcast((train(texts, labelled, vectors, sample), vectors))

    @F.arrow_udf("double")
    def text_score(column: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([column], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *[text_scores(part, *shared.value) for part in wh.slices(whole, "text")]]))

    return docs.filter(text_score(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) >= threshold)
