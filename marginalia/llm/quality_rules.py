"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded labelled sample, with monotonic constraints, and
flattened into numpy node arrays, so that a batch of documents walks all trees level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.common import hash_words, ngram_hashes, words
from marginalia.session import materialize

_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which each may move the score: -1 only down, 0 free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": -1, "exclamations_per_word": -1, "digit_share": 0, "distinct_share": 0, "twin_share": -1, "line_words": 0}
MAX_LABELLED = 20_000
KEEP_FROM = 0.3


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    text = text or ""
    own = words(text)
    n = len(own)
    h = hash_words(own)
    repeated = 0
    if n >= 3:
        _, codes, counts = np.unique(ngram_hashes(h, 3), return_inverse=True, return_counts=True)
        starts = counts[codes] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + n - 2] |= starts
        repeated = int(cover.sum())
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            lines += 1
            again += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(_SYMBOL.findall(text))
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower, digits = count(_UPPER), count(_LOWER), count(_DIGIT)
    many = max(n, 1)
    features = [
        float(np.log1p(n)), chars / many, symbols / many, again / max(lines, 1), repeated / many, upper / max(upper + lower, 1),
        raw.count(b"!") / many, digits / max(chars, 1), len(np.unique(h)) / many, float((h[1:] == h[:-1]).sum()) / many, n / max(lines, 1),
    ]
    return [n, chars, symbols, again, repeated], features


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(5)],
             pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["doc_id", *STATISTICS, "features"])


@dataclass
class Trees:
    """All trees in flat arrays: ``feature`` is -1 at a leaf, children are indexes, ``roots`` the first node of each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            f = np.where(inner, self.feature[at], 0)
            down = np.where(x[rows, f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosting with logistic loss. A split that would break a feature's sign is not taken, and
    the middle of its two values bounds all leaves below, so the whole tree obeys the sign."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rate_of = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(feature)
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        for a, v in zip((feature, cut, left, right, value), (-1, 0.0, 0, 0, rate * own)):
            a.append(v)
        if level < depth and len(rows) > 1:
            best = (1e-6, None)
            g_all, h_all = g[rows].sum(), h[rows].sum()
            gain_of = lambda gs, hs: gs * gs / (hs + ridge)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                c = codes[rows, f]
                gs = np.cumsum(np.bincount(c, g[rows], len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(c, h[rows], len(edges) + 1))[:-1]
                lv = np.clip(-gs / (hs + ridge), low, high)
                rv = np.clip(-(g_all - gs) / (h_all - hs + ridge), low, high)
                gain = gain_of(gs, hs) + gain_of(g_all - gs, h_all - hs) - gain_of(g_all, h_all)
                ok = (hs * 4 >= least) & ((h_all - hs) * 4 >= least)
                if signs[f]:
                    ok &= signs[f] * (rv - lv) >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, float(lv[k]), float(rv[k])))
            if best[1]:
                f, k, lv, rv = best[1]
                middle = (lv + rv) / 2
                feature[me], cut[me] = f, float(cuts[f][k])
                below = codes[rows, f] <= k
                l_bounds, r_bounds = ((low, high), (low, high))
                if signs[f] > 0:
                    l_bounds, r_bounds = (low, middle), (middle, high)
                elif signs[f] < 0:
                    l_bounds, r_bounds = (middle, high), (low, middle)
                left[me] = grow(rows[below], g, h, level + 1, *l_bounds)
                right[me] = grow(rows[~below], g, h, level + 1, *r_bounds)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), 0.0)
        margin = margin + tree.margin(x)
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), base)


def labelled_sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` labelled ids outside the held-out fold, in the order of a hash; the lowest label of an id counts."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def collect_training(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``features`` and ``quality`` of a bounded sample, in the order of the ids; of rows that share an id the least counts."""
    once = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features"))
    found = sorted(once.collect(), key=lambda r: r.doc_id)
    return np.array([r.features for r in found], float), np.array([r.quality for r in found], float)


def _score(trees: Trees | None, keep_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = {c: np.array(batch.column(c)) for c in STATISTICS}
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            score = trees.score(x) if trees else np.full(len(x), 0.5)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in STATISTICS], pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)],
                names=["doc_id", *STATISTICS, "base_failed", "kept", "score"])

    return run


def apply_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts and verdict per row of ``docs``; the trees learn ``labels.quality`` on at most ``max_labelled`` rows.

    ``base_failed`` and the counts follow fixed rules; ``kept`` is false there and else whether
    the trees' score is at least ``keep_from``. Null and empty texts have no words and fail the
    base rule. Rows without doc_id are judged but never learnt from; of several labels of one
    document the lowest counts. Without labels, or with one kind only, every score is 0.5.
    Texts are read once; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spec = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", features array<double>"
    found = materialize(docs.mapInArrow(_statistics, spec))
    x, y = collect_training(found.select("doc_id", "features").join(F.broadcast(labelled_sample(labels, max_labelled)), "doc_id"))
    trees = fit_trees(x, y, list(FEATURES.values())) if len(set(y)) > 1 else None
    return found.mapInArrow(_score(trees, keep_from), spec.replace("features array<double>", "base_failed boolean, kept boolean, score double"))
