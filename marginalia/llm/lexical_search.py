"""Ranked search by a whole-number BM25 with max-sketches as upper bounds.

A document's sketch has a power of two of coordinates, about ``SPACE`` for each of its distinct
terms. Every term is hashed to two coordinates; each holds the greatest impact of the terms that
fall on it. A query term's impact is at most the lesser of what stands at its coordinates, so the
weighted sum over a query's terms bounds the document's score from above. The bounds of all queries of a block
against a group of documents are one matrix product. Each query then rescores documents exactly
by descending bound until the next bound is below its tenth score so far.

Queries are taken in blocks of bounded size, each with two passes over the documents: one for the
counts that weights and impacts rest on, one for the search. A task carries its best rows from
group to group and hands on at most ``top`` rows per query; nothing else is shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marginalia.llm.common import parts
from marginalia.session import ensure_checkpoint_dir

#: Bytes that separate terms become blanks, A-Z lower case; all others, those of non-ASCII characters too, stay.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

#: Queries of a block, and distinct terms beyond which a block takes no further query.
BLOCK_QUERIES, BLOCK_TERMS = 256, 20_000
#: Coordinates of a sketch per distinct term, at least.
SPACE, LEAST = 8, 64
#: Odd factors, one per coordinate of a term.
COORDINATES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Looked-up impacts, documents times query terms, that are held at once, and text bytes of a group of documents.
CELLS, BYTES = 2_000_000, 1 << 20
#: Terms whose hash is kept; beyond it all are forgotten.
KNOWN = 200_000


def terms(text: str | None) -> list[bytes]:
    """Maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; null has none."""
    return text.encode("utf-8").translate(_TERM).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Codes(dict):
    """Code of a term: the place of a query term among the block's, else its hash moved behind those places."""

    def __init__(self, query_terms: list[bytes]) -> None:
        super().__init__()
        self.query_terms = {t: k for k, t in enumerate(query_terms)}

    def __missing__(self, term: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        code = self.query_terms.get(term)
        if code is None:
            code = len(self.query_terms) + (xxhash.xxh3_64_intdigest(term) >> 20)
        self[term] = code
        return code


@dataclass
class Block:
    """A bounded number of queries: ``(place, item_id)`` and term counts of each, and their distinct terms."""

    items: list[tuple[int, int | None]]
    counts: list[Counter]
    terms: list[bytes]


def blocks(queries: Iterable[tuple], most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """Queries ``(item_id, text)`` in blocks; those without a term are left out, having no score above 0."""
    items, counts, seen = [], [], {}
    for place, (item_id, text) in enumerate(queries):
        count = Counter(terms(text))
        if not count:
            continue
        if items and (len(items) >= most_queries or len(seen.keys() | count.keys()) > most_terms):
            yield Block(items, counts, list(seen))
            items, counts, seen = [], [], {}
        items.append((place, item_id))
        counts.append(count)
        seen |= dict.fromkeys(count)
    if items:
        yield Block(items, counts, list(seen))


def _counted(query_terms: list[bytes]):
    """Per task, as ``(code, n)``: documents that hold each query term; code -1: documents with a term, -2: all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: k for k, t in enumerate(query_terms)}
        wanted = places.keys()
        found: Counter = Counter()
        documents = total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = terms(text)
                documents += bool(own)
                total += len(own)
                found.update(wanted & set(own))
        rows = [(-1, documents), (-2, total)] + [(places[t], n) for t, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["code", "n"])

    return run


def corpus_counts(docs: DataFrame, query_terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and for each query term the documents that hold it."""
    rows = docs.select("text").mapInArrow(_counted(query_terms), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    found = {r.code: r.n for r in rows}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(query_terms))], np.int64)


class Sketches:
    """Max-sketches of a group of documents, one behind the other, with the exact impacts of query terms beside."""

    def __init__(self, counts: list[Counter], m: np.ndarray, codes: Codes) -> None:
        self.known = len(codes.query_terms)
        sizes = np.array([len(c) for c in counts], np.int64)
        owner = np.repeat(np.arange(len(counts)), sizes)
        code = np.fromiter((codes[t] for c in counts for t in c), np.int64, len(owner))
        impact = impacts(np.fromiter((n for c in counts for n in c.values()), np.int64, len(owner)), m[owner])
        self.width = np.int64(1) << np.ceil(np.log2(np.maximum(sizes * SPACE, LEAST))).astype(np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.cells = np.zeros(int(self.width.sum()), np.int64)
        order = np.argsort(impact, kind="stable")  # where terms meet, the last written and so the greatest stays
        for coordinate in COORDINATES:
            at = self.start[owner] + (spread(code, coordinate) & (self.width - 1)[owner])
            self.cells[at[order]] = np.maximum(self.cells[at[order]], impact[order])
        asked = code < self.known
        self.owner, self.code, self.impact = owner[asked], code[asked], impact[asked]

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores, documents by queries: impacts at the coordinates of all query terms, times their weights."""
        looked_up = np.minimum(*[
            self.cells[self.start[:, None] + (spread(np.arange(self.known), coordinate) & (self.width - 1)[:, None])] for coordinate in COORDINATES])
        return looked_up.astype(np.float64) @ weights

    def exact(self) -> np.ndarray:
        """Impacts of query terms, documents by terms."""
        table = np.zeros((len(self.width), self.known), np.int64)
        table[self.owner, self.code] = self.impact
        return table


def spread(code: np.ndarray, factor: int) -> np.ndarray:
    """Coordinate of a code before it is cut to a sketch's width."""
    return (code.astype(np.uint64) * np.uint64(factor) >> np.uint64(24)).astype(np.int64)


class Best:
    """The ``top`` best ``(score, doc_id)`` of one query: higher scores first, then smaller ids, then rows without id."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """A document needs this score, or the same, to come in."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scored: Iterable[tuple]) -> None:
        self.rows = sorted(self.rows + [s for s in scored if s[0] >= self.least], key=lambda s: (-s[0], s[1] is None, s[1] or 0))[: self.top]


def weight_matrix(known: int, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights by query term and query, of each query's ``(codes, weights)``."""
    matrix = np.zeros((known, len(queries)))
    for k, (codes, weights) in enumerate(queries):
        matrix[codes, k] = weights
    return matrix


def search_group(sketches: Sketches, ids: list, queries: list[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray, best: list[Best]) -> int:
    """Rescores by descending bound until the next bound is below a query's threshold; how many scores that took."""
    bounds = sketches.bounds(matrix) * (1 + 1e-9)  # sums beyond 2 ** 53 may have been rounded
    table, rescored = sketches.exact(), 0
    for k, (held, (codes, weights)) in enumerate(zip(best, queries)):
        near = np.flatnonzero(bounds[:, k] >= held.least)
        near = near[np.argsort(-bounds[near, k], kind="stable")]
        at, step = 0, held.top
        while at < len(near) and bounds[near[at], k] >= held.least:
            some = near[at : at + step]
            scores = (table[np.ix_(some, codes)] * weights).sum(axis=1)
            held.add(zip(scores.tolist(), [ids[d] for d in some.tolist()]))
            rescored += len(some)
            at, step = at + step, 2 * step
    return rescored


def _searched(block: Block, weights: np.ndarray, documents: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(block.terms)
        asked = [np.array([codes.query_terms[t] for t in c], np.int64) for c in block.counts]
        queries = [(k, weights[k] * np.fromiter(c.values(), np.int64, len(c))) for k, c in zip(asked, block.counts)]
        matrix = weight_matrix(len(block.terms), queries)
        best = [Best(top) for _ in block.items]
        rows_at_once = max(1, CELLS // len(block.terms))

        def counted() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    own = terms(text)
                    if own:
                        yield doc_id, len(own), Counter(own)

        for some in parts(counted(), lambda r: max(BYTES // rows_at_once, 8 * len(r[2])), BYTES):
            n = np.array([r[1] for r in some], np.int64)
            sketches = Sketches([r[2] for r in some], 25 + 75 * n * documents // total, codes)
            search_group(sketches, [r[0] for r in some], queries, matrix, best)
        out = [(*item, *row) for item, held in zip(block.items, best) for row in held.rows]
        names = ["place", "item_id", "score", "doc_id"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=names)

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 10, most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best rows of ``docs`` (``doc_id``, ``text``) per row of ``queries`` (``item_id``, ``text``).

    Scores are exact and above 0; equal scores go by ascending doc_id, rows without doc_id last.
    Null and empty texts, or texts without a term, are no documents and get no rows as queries.
    Queries that share an item_id, or have none, are each answered; so do rows that repeat each
    count as a document. A query is never cut: one of more than ``most_terms`` terms is a block
    of its own. Other columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator()
    spark, spec = docs.sparkSession, "place long, item_id long, score long, doc_id long"
    folder, written = f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}", []
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in blocks(((r[0], r[1]) for r in asked), most_queries, most_terms):
        documents, total, holding = corpus_counts(docs, block.terms)
        if documents:
            weights = np.array([weight(documents, int(df)) for df in holding], np.int64)
            found = docs.mapInArrow(_searched(block, weights, documents, total, top), spec)
            ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
            written.append(f"{folder}/{len(written)}")
            ranked.select("item_id", "rank", "doc_id", "score").write.parquet(written[-1])
    result = "item_id long, rank int, doc_id long, score long"
    return spark.read.schema(result).parquet(*written) if written else spark.createDataFrame([], result)
