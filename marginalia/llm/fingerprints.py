"""Document fingerprints from improbable byte windows, kept in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy level. How many windows of the corpus have each
level says how improbable it is: the rarest level comes first in rank; levels below ``WEAK`` are
left out, being runs of few characters that unrelated texts share. In each run of ``RUN``
consecutive windows the first one of the best rank gets a point, and windows of ``POINTS``
points are the features. A feature sets ``HASHES`` bits; after ``FEATURES`` features the next
filter of the chain begins.

Two fingerprints are compared by the overlap of their filters, normalised between what chance
gives and full containment: each filter of the shorter chain takes its best partner.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.common import parts, stored

WINDOW, RUN, POINTS = 64, 64, 16
LEVELS, WEAK = 1000, 100
BITS, HASHES, FEATURES = 2048, 5, 160
#: Texts with fewer features than this take their windows of fewer points too.
FEW = 16
#: Text bytes that are looked at together; a longer text is alone.
BYTES = 1 << 18

SCALE = 1 << 20
_COUNTS = np.arange(WINDOW + 1)
_WEIGHT = np.rint(SCALE * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_STEP = np.diff(_WEIGHT)
_FULL = int(_WEIGHT[WINDOW])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of bytes, from 0 to ``LEVELS``, in whole numbers, so that equal windows have equal levels.

    The sum of ``c log c`` over byte counts changes by one step for the byte that leaves and one
    for the byte that comes; how often each stands in between is counted for all positions at once.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for gap in range(1, WINDOW):
        same = (data[gap:] == data[:-gap]).view(np.uint8)
        before[gap:] += same
        after[:-gap] += same
    sums = np.empty(n, np.int64)
    sums[0] = _WEIGHT[np.bincount(data[:WINDOW], minlength=256)].sum()
    sums[1:] = _STEP[before[WINDOW:]] - _STEP[after[: n - 1]]
    return (_FULL - np.cumsum(sums)) * LEVELS // _FULL


def level_counts(texts: list[bytes]) -> np.ndarray:
    """Windows per level over some texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    levels = entropy_levels(data)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie in one text
    start = 0
    for text in texts:
        if len(text) >= WINDOW:
            inside[start] += 1
            inside[start + len(text) - WINDOW + 1] -= 1
        start += len(text)
    return np.bincount(levels[np.cumsum(inside)[: len(levels)] > 0], minlength=LEVELS + 1)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, 0 the rarest; levels below ``WEAK`` get the last, ``LEVELS + 1``. Levels unseen come first; ties by level."""
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:WEAK] = LEVELS + 1
    return ranks


def _run_minima(keys: np.ndarray, run: int) -> np.ndarray:
    """Minimum of each ``run`` consecutive keys; ``run`` is a power of two."""
    width = 1
    while width < run:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys


def feature_places(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Places of the features of each text, ascending; none where no window has a rank."""
    levels = entropy_levels(np.frombuffer(b"".join(texts), np.uint8))
    keys = ranks[levels] << 32 | np.arange(len(levels))
    best = _run_minima(keys, RUN) if len(keys) >= RUN else keys[:0]
    out, start = [], 0
    for text in texts:
        n = len(text) - WINDOW + 1
        if n <= 0:
            found = keys[:0]
        elif n < RUN:
            found = keys[start : start + n].min(keepdims=True)
        else:
            found = best[start : start + n - RUN + 1]
        found = found[found >> 32 <= LEVELS]
        places, points = np.unique((found & 0xFFFFFFFF) - start, return_counts=True)
        if np.count_nonzero(points >= POINTS) >= FEW:
            places = places[points >= POINTS]
        else:
            places = np.sort(places[np.argsort(-points, kind="stable")[:FEW]])
        out.append(places)
        start += len(text)
    return out


def filters_of(features: list[bytes]) -> np.ndarray:
    """Rows of ``BITS`` booleans, one per filter of the chain, of the distinct features in order of their first place."""
    hashes = np.array(list(dict.fromkeys(map(xxhash.xxh3_64_intdigest, features))), np.uint64)
    rows = np.zeros((-(-len(hashes) // FEATURES), BITS), bool)
    width = BITS.bit_length() - 1
    for k in range(HASHES):
        rows[np.arange(len(hashes)) // FEATURES, (hashes >> np.uint64(k * width)).astype(np.int64) & (BITS - 1)] = True
    return rows


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Filters of each text. A text without a feature is one feature as a whole; an empty text has no filter."""
    return [filters_of([text[p : p + WINDOW] for p in places.tolist()] or [text] * bool(text))
            for text, places in zip(texts, feature_places(texts, ranks))]


def digest(filters: np.ndarray) -> str:
    """The chain as text: base64 of the filters' bits; empty without filters."""
    return base64.b64encode(np.packbits(filters).tobytes()).decode("ascii")


def read_digest(text: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8)).reshape(-1, BITS).astype(bool)


def likeness(one: np.ndarray, other: np.ndarray, block: int = 256) -> float:
    """Normalised overlap from 0 to 1, in either order the same: 1 for equal chains, two empty ones too, 0 if only one is empty.

    Filters of the chain with fewer bits set are weighted by their bits. Chains of any length
    are compared block by block.
    """
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    if (len(one), one.sum(), one.tobytes()) > (len(other), other.sum(), other.tobytes()):
        one, other = other, one
    a, b = one.sum(axis=1, dtype=np.float64), other.sum(axis=1, dtype=np.float64)
    best = np.zeros(len(one))
    for i in range(0, len(one), block):
        rows = one[i : i + block].astype(np.float32)
        for j in range(0, len(other), block):
            common = rows @ other[j : j + block].astype(np.float32).T
            chance = np.outer(a[i : i + block], b[j : j + block]) / BITS
            full = np.minimum.outer(a[i : i + block], b[j : j + block])
            near = (common - chance) / np.maximum(full - chance, 1e-9)
            best[i : i + block] = np.maximum(best[i : i + block], near.max(axis=1))
    return float(np.minimum(best, 1.0) @ a / a.sum())


def edited(text: str, following: str) -> str:
    """The last half of the characters, rounded down, replaced by as many first ones of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]


def _compare(rows: list[tuple], ranks: np.ndarray) -> list[list]:
    """Result rows of ``(doc_id, text, next text)``."""
    changed = [edited(text, following) for _, text, following in rows]
    every = list(dict.fromkeys([t for _, *two in rows for t in two] + changed))
    known = dict(zip(every, fingerprints([t.encode("utf-8") for t in every], ranks)))
    return [[doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), digest(known[text]), digest(known[new]),
             likeness(known[text], known[new]), likeness(known[text], known[following])]
            for (doc_id, text, following), new in zip(rows, changed)]


def _along(ranks: np.ndarray):
    """Rows of a sorted partition against their followers; its first and last text go out for the partitions beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None

        def pairs() -> Iterator[tuple]:
            nonlocal first, last
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if last is None:
                        first = (doc_id, text)
                    else:
                        yield (*last, text)
                    last = (doc_id, text)

        def edge(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            columns = [[doc_id], *[[None]] * 6, [kind], [part], [text]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        types = [*TYPES, pa.string(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in RESULT.split(", ")] + ["kind", "part", "text"]
        for some in parts(pairs(), lambda r: 2 * len(r[1]) + 64, BYTES):
            out = [row + ["row", part, None] for row in _compare(some, ranks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        if first is not None:
            yield edge("first", *first)
            yield edge("last", *last)

    return run


def _beside(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")]))
            out = _compare(rows, ranks)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(TYPES)], names=names)

    return run


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels by their windows in all texts; one number per level reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            texts = ((t.encode("utf-8"),) for t in batch.column("text").to_pylist())
            for some in parts(texts, lambda r: len(r[0]), BYTES):
                total += level_counts([t for t, in some])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["level", "windows"])

    found = docs.select("text").mapInArrow(run, "level int, windows long").groupBy("level").agg(F.sum("windows").alias("windows")).collect()
    counts = np.zeros(LEVELS + 1, np.int64)
    for row in found:
        counts[row.level] = row.windows
    return ranks_of(counts)


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of the whole texts of ``docs`` (``doc_id``, ``text``), of their edited texts, and likenesses; see ``RESULT``.

    ``ranks`` orders the entropy levels; by default they are counted over all of ``docs``. The
    next document is the one of the next smaller doc_id; rows without doc_id come after all
    others, rows of one doc_id in the order of their texts' hashes, equal rows one after another;
    the first follows the last, so a single row follows itself. Null texts are empty; an empty
    text has an empty fingerprint. Other columns are ignored; an empty table gives an empty result.

    The texts are shuffled once, into ranges of that order. Only where a range ends does a
    document meet its next in a join, of two rows per partition.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranks is None:
        ranks = corpus_ranks(docs)
    order: list[Column] = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("number")]
    placed = docs.withColumn("mark", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stored(ranges.mapInArrow(_along(ranks), RESULT + ", kind string, part int, text string"))
    filled = sorted(r.part for r in found.where("kind = 'first'").select("part").collect())  # one number per partition
    after = dict(zip(filled, filled[1:] + filled[:1]))
    following = docs.sparkSession.createDataFrame(list(after.items()), "part int, next_part int")
    firsts = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = found.where("kind = 'last'").select("part", "doc_id", "text")
    beside = lasts.join(following, "part").join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(_beside(ranks), RESULT)
    return found.where("kind = 'row'").drop("kind", "part", "text").unionByName(beside)
