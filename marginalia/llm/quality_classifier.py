"""A quality score from random-indexing word vectors and a small calibrated network.

Words and word shapes (letters, capitals, digits and other characters by place) are hashed to
a fixed number of rows. Each row has a sparse random index vector and gathers the index
vectors of its neighbours over the whole corpus; the sums, scaled, are the word vectors.
A document is the mean of its word vectors, of its shape vectors and of the steps between
neighbouring words. A two-layer network scores it; a temperature, fitted on rows that the
network did not see, calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.common import WordCodes, filter_texts, hash_words, mix
from marginalia.llm.quality_rules import collect_training, labelled_sample

#: Rows for words and for shapes, and the length of a vector: the size of what is sent to each task.
WORD_ROWS, SHAPE_ROWS, DIM, NONZERO = 1 << 14, 1 << 11, 32, 4
MAX_LABELLED = 20_000
THRESHOLD = 0.3
CHUNK = 1 << 16
_SHAPE = bytes(b if b in b" \t\n\v\f\r" else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b
               for b in range(256))


def index_vectors() -> np.ndarray:
    """Ternary index vectors with a few places other than zero, drawn from a hash of the row."""
    rows = np.arange(WORD_ROWS + SHAPE_ROWS, dtype=np.uint64)
    out = np.zeros((len(rows), DIM), np.int8)
    for k in range(NONZERO):
        h = mix(rows * np.uint64(NONZERO) + np.uint64(k + 1))
        np.add.at(out, (np.arange(len(rows)), (h % np.uint64(DIM)).astype(int)), np.where(h >> np.uint64(63), 1, -1).astype(np.int8))
    return out


class Coder:
    """Rows of a text's words and of their shapes; there are few shapes, so theirs are looked up."""

    def __init__(self) -> None:
        self.shapes = WordCodes(SHAPE_ROWS, WORD_ROWS)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        return (hash_words(raw.split()) % np.uint64(WORD_ROWS)).astype(np.uint16), self.shapes.of(raw.translate(_SHAPE).split())


def add_contexts(table: np.ndarray, index: np.ndarray, c: np.ndarray) -> None:
    """Adds to each row the index vectors of the words beside it."""
    if len(c) < 2:
        return
    v = index[c]
    near = np.empty_like(v)
    near[1:-1] = v[:-2] + v[2:]  # the sums of two ternary vectors with few places fit a byte
    near[0], near[-1] = v[1], v[-2]
    order = np.argsort(c, kind="stable")
    own = c[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    table[own[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int32)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, codes = index_vectors(), Coder()
    sums = np.zeros((WORD_ROWS + SHAPE_ROWS, DIM), np.int64)
    held: list[list[np.ndarray]] = [[], []]
    size = 0

    def spill() -> None:
        for part in held:
            if part:
                add_contexts(sums, index, np.concatenate(part))
                part.clear()

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for part, c in zip(held, codes(text)):
                part.append(c)
            size += len(held[0][-1])
            if size > 4 * CHUNK:
                spill()
                size = 0
    spill()
    rows = np.flatnonzero(np.abs(sums).sum(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows.astype(np.int32)), pa.array(list(sums[rows]), pa.list_(pa.int64()))], names=["row", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors gathered over all texts; the result has a fixed size whatever the corpus."""
    parts = docs.select("text").mapInArrow(_gather, "row int, sums array<long>")
    total = parts.groupBy("row").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(DIM)]).collect()
    out = np.zeros((WORD_ROWS + SHAPE_ROWS, DIM))
    for r in total:
        out[r[0]] = r[1:]
    # hashed rows that never met a neighbour keep their own index vector
    out = np.where(np.abs(out).sum(axis=1, keepdims=True) > 0, out, index_vectors())
    for part in (slice(0, WORD_ROWS), slice(WORD_ROWS, None)):
        unit = out[part] / np.maximum(np.linalg.norm(out[part], axis=1, keepdims=True), 1e-9)
        unit = unit - unit.mean(axis=0)  # the direction that all words share says nothing
        out[part] = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, codes: Coder) -> np.ndarray:
    w, s = codes(text)
    out = np.zeros(3 * DIM + 1)
    n = len(w)
    if n:
        previous = None
        for at in range(0, n, CHUNK):
            v = vectors[w[at : at + CHUNK]]
            ones = np.ones(len(v), np.float32)
            out[:DIM] += ones @ v
            shapes, counts = np.unique(s[at : at + CHUNK], return_counts=True)
            out[DIM : 2 * DIM] += counts.astype(np.float32) @ vectors[shapes]
            if previous is not None:
                out[2 * DIM : 3 * DIM] += np.abs(v[0] - previous)
            steps = v[1:] - v[:-1]
            out[2 * DIM : 3 * DIM] += ones[1:] @ np.abs(steps, out=steps)
            previous = v[-1]
        out[: 2 * DIM] /= n
        out[2 * DIM : 3 * DIM] /= max(n - 1, 1)
    out[-1] = np.log1p(n)
    return out


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Coder()
        for batch in batches:
            rows = [pooled(t, vectors, codes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    return run


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on three quarters of the rows; the temperature is the one that fits the others best."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    apart = order[: len(y) // 4] if len(y) >= 40 else order
    own = order[len(y) // 4 :] if len(y) >= 40 else order
    net = Network(x[own].mean(axis=0), x[own].std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
                  np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            rows = own[at : at + batch]
            a = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - a * a)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), a.T @ d + decay * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    logits = net.logit(x[apart])
    loss = lambda t: np.logaddexp(0, -np.where(y[apart] > 0, 1, -1) * logits / t).mean()
    net.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    net: Network | None

    def scores(self, texts: list[str | None], codes: Coder) -> np.ndarray:
        if not self.net or not texts:
            return np.full(len(texts), 0.5)
        return self.net.score(np.array([pooled(t, self.vectors, codes) for t in texts]))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Word vectors from all texts, the network from at most ``max_labelled`` labelled ones outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(docs)
    sample = docs.join(F.broadcast(labelled_sample(labels, max_labelled)), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    x, y = collect_training(sample.mapInArrow(_pool(vectors), "doc_id long, quality int, features array<double>"))
    return Classifier(vectors, fit_network(x, y) if len(set(y)) > 1 else None)


def _score(model: Classifier, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Coder()
        for batch in batches:
            score = model.scores(batch.column("text").to_pylist(), codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Word vectors gather over all texts; the network learns ``labels.quality`` from at most
    ``max_labelled`` rows whose crc32 of the doc_id, modulo 5, is not 0. Only the text makes
    the score. Null and empty texts are scored like any other, by their zero vector. Rows
    without doc_id are scored and count as held out. Of several labels of one document the
    lowest counts. Without labels, or with one kind only, every score is 0.5. An empty table
    gives an empty result; other columns are ignored.
    """
    model = fit_classifier(docs, labels, max_labelled)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(model, threshold), "doc_id long, score double, predicted int")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject. Null and empty texts are
    scored like any other; without labels, or with one kind only, every score is 0.5. An empty table stays empty."""
    model = fit_classifier(docs, labels, max_labelled)

    def test() -> Callable[[list[str | None]], list[bool]]:
        codes = Coder()
        return lambda texts: (model.scores(texts, codes) >= threshold).tolist()

    return filter_texts(docs, test)
