"""Removal of passages that repeat across documents, by level-wise doubling of window lengths.

Level 1 hashes windows of half the wanted length. Of every run of them that lies in one full
window, the smallest hash stands for the run, so equal full windows have an equal anchor and
few rows are shuffled. Level 2 extends only anchors that occur in more than one text to
windows of twice the length. Anchors whose surroundings, wide enough for all their windows,
equal those of a smaller doc_id are settled at once; only the others are looked at window by
window. The smallest doc_id always keeps its windows, so every other one finds them.

Equal anchors of neighbouring documents are gathered into one row before they are shuffled
and dealt out to their documents afterwards, so a passage that very many documents share
costs the joins a row per bunch of documents and not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from marginalia.llm.common import hash_words, ngram_hashes, signed, words
from marginalia.session import materialize


#: Places of the map that says which texts may need a join: 2**22 bits are 1 MB to broadcast.
MAP_BITS = 22
#: Anchors that are gathered at a time, the places one gathered row holds, and rows per Arrow batch.
BUNCH, ROW_PLACES, BATCH_ROWS = 1 << 18, 1024, 8192
GROUPS = "mark long, wide long, bunch long, docs array<long>, digests array<long>, places array<int>"


def anchors(h: np.ndarray, window: int, part: int) -> np.ndarray:
    """Positions of the smallest part hash of each window, each position once."""
    g = ngram_hashes(h, part)
    span = window - part + 1
    if len(g) < span:
        return np.empty(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(g, span)
    chosen = [np.argmin(low[at : at + 4096], axis=1) + np.arange(at, min(at + 4096, len(low))) for at in range(0, len(low), 4096)]
    return np.unique(np.concatenate(chosen))


def _anchors(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, wides, places = [], [], []
            side = window - part
            for text in batch.column("text").to_pylist():
                h = hash_words(words(text))
                p = anchors(h, window, part)
                g = ngram_hashes(h, part + 2 * side)
                inside = (p >= side) & (p - side < len(g))
                wide = g[np.where(inside, p - side, 0)] if inside.any() else np.zeros(len(p), np.uint64)
                marks.append(signed(ngram_hashes(h, part)[p]) if len(p) else np.empty(0, np.int64))
                wides.append(pa.array(signed(wide), mask=~inside))
                places.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(marks, pa.list_(pa.int64())),
                 pa.array([w.to_pylist() for w in wides], pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "digest", "marks", "wides", "places"])

    return run


def _extend(window: int, part: int):
    """Full windows around the anchors that survived, but for those that the settled anchors answer for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, places = [], []
            reach = np.arange(window - part + 1)
            for text, survivors, settled in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "settled"))):
                g = ngram_hashes(hash_words(words(text)), window)
                near = np.asarray(survivors, np.int64)[:, None] - reach
                p = np.setdiff1d(near[(near >= 0) & (near < len(g))], np.asarray(settled, np.int64)[:, None] - reach)
                marks.append(signed(g[p]))
                places.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(marks, pa.list_(pa.int64())),
                 pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "digest", "marks", "places"])

    return run


def keep_mask(n_words: int, starts: list[int] | None, whole: bool, window: int) -> np.ndarray:
    """True for words that no removed window covers."""
    if whole:
        return np.zeros(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    for start in starts or ():
        edge[start] += 1
        edge[start + window] -= 1
    return np.cumsum(edge[:-1]) == 0


def cut(text: str, keep: np.ndarray) -> str:
    """The text without the words that go: lines stay lines, emptied lines go too."""
    lines, at = [], 0
    for line in text.split("\n"):
        own = words(line)
        stay = keep[at : at + len(own)]
        at += len(own)
        if stay.all():
            lines.append(line)
        elif stay.any():
            lines.append(b" ".join(w for w, k in zip(own, stay) if k).decode("utf-8", "surrogatepass"))
    return "\n".join(lines)


def _finish(window: int, with_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "whole"))):
                own = words(text)
                keep = keep_mask(len(own), starts, bool(whole) and len(own) >= window, window)
                removed = len(own) - int(keep.sum())
                kept = own if not removed else [w for w, k in zip(own, keep) if k]
                rows.append((len(own), removed, hashlib.sha256(b" ".join(kept)).hexdigest(),
                             (cut(text, keep) if removed else text) if with_rows else None))
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            more = [arrays[3], batch.column("row")] if with_rows else []
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[:3], *more], names=names[: 4 + len(more)])

    return run


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new combination of keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return new


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one document each, with arrays, to rows of one mark (and its surroundings) each, for a bunch of documents."""
    from pyspark import TaskContext

    context = TaskContext.get()
    bunch = (context.partitionId() if context else 0) << 33
    for batch in batches:
        marks, places = (_flat(batch.column(c)) for c in ("marks", "places"))
        if "wides" in batch.schema.names:
            wide = batch.column("wides").flatten()
            known, wide = wide.is_valid().to_numpy(zero_copy_only=False), wide.fill_null(0).to_numpy(zero_copy_only=False)
        else:
            known, wide = np.zeros(len(marks), bool), np.zeros(len(marks), np.int64)
        sizes = batch.column("marks").value_lengths().to_numpy(zero_copy_only=False)
        docs, digests = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("doc_id", "digest"))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(marks):
            # whole documents, as many as fit in a bunch, one at least
            hi = int(ends[max(np.searchsorted(ends, lo + BUNCH, "right") - 1, np.searchsorted(ends, lo, "right"))])
            order = lo + np.lexsort((wide[lo:hi], known[lo:hi], marks[lo:hi]))
            m, w, k = marks[order], wide[order], known[order]
            new = _starts(m, w, k)
            at = np.arange(len(m))
            new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % ROW_PLACES == 0
            first = np.flatnonzero(new)
            offsets = np.r_[first, len(m)]
            rows = pa.RecordBatch.from_arrays(
                [pa.array(m[first]), pa.array(w[first], mask=~k[first]), pa.array(np.full(len(first), bunch)),
                 _lists(offsets, docs[order]), _lists(offsets, digests[order]), _lists(offsets, places[order])],
                names=["mark", "wide", "bunch", "docs", "digests", "places"])
            for part in range(0, len(first), BATCH_ROWS):
                yield rows.slice(part, BATCH_ROWS)
            lo, bunch = hi, bunch + 1


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathered rows, sorted by bunch, back to one row per document; ``settled`` are the places whose ``first_doc`` is smaller."""
    held: list[tuple[np.ndarray, ...]] = []

    def dealt() -> pa.RecordBatch:
        doc, digest, place, late = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((place, digest, doc))
        order = order[_starts(doc[order], digest[order], place[order])]
        doc, digest, place, late = doc[order], digest[order], place[order], late[order]
        first = np.flatnonzero(_starts(doc, digest))
        settled = np.r_[0, np.cumsum(late)][np.r_[first, len(doc)]]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[first]), pa.array(digest[first]), _lists(np.r_[first, len(doc)], place), _lists(settled, place[late])],
            names=["doc_id", "digest", "places", "settled"])

    now = None
    for batch in batches:
        bunches = batch.column("bunch").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(_starts(bunches))
        for lo, hi in zip(cuts, [*cuts[1:], len(bunches)]):
            if held and bunches[lo] != now:
                yield dealt()
            now, part = bunches[lo], batch.slice(lo, hi - lo)
            doc = _flat(part.column("docs"))
            first = part.column("first_doc").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            late = doc > np.repeat(first, part.column("docs").value_lengths().to_numpy(zero_copy_only=False))
            held.append((doc, _flat(part.column("digests")), _flat(part.column("places")), late))
    if held:
        yield dealt()


def _repeated(rows: DataFrame, mark: str, how: str = "inner") -> DataFrame:
    """Adds ``first_doc``, the smallest doc_id with the same mark, to gathered rows whose mark occurs in more than one text."""
    shared = rows.groupBy(mark).agg(
        F.min(F.array_min("docs")).alias("first_doc"), F.min(F.array_min("digests")).alias("low"), F.max(F.array_max("digests")).alias("high"))
    # written first, so that the join shuffles both sides itself and splits a mark that very many texts share
    return rows.join(materialize(shared.where("low <> high").select(mark, "first_doc")), mark, how)


def _by_text(rows: DataFrame) -> DataFrame:
    """Gathered rows with ``first_doc`` to ``(doc_id, digest, places, settled)``, one row per text."""
    rows = rows.select("bunch", "first_doc", "docs", "digests", "places").repartition("bunch").sortWithinPartitions("bunch")
    dealt = rows.mapInArrow(_deal, "doc_id long, digest long, places array<int>, settled array<int>")
    # repeated rows of one text give equal arrays, which count once
    return dealt.groupBy("doc_id", "digest").agg(*[F.flatten(F.collect_set(c)).alias(c) for c in ("places", "settled")])


def _maybe_in(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``maybe``: false where ``(doc_id, digest)`` is surely none of ``keys``.

    The keys set bits of a map of fixed size, which alone is broadcast, so that texts that
    need no join are never shuffled. With very many keys it tells little and nothing is lost.
    """
    place = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << MAP_BITS))
    at = lambda df: df.withColumn("word", F.shiftright(place, 6)).withColumn("bit", (place % 64).cast("int"))
    bits = at(keys).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    known = at(docs).join(F.broadcast(bits), "word", "left")
    return known.withColumn("maybe", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False))).drop("word", "bit", "bits")


def repeated_passages(docs: DataFrame, window: int = 50, with_rows: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row; ``with_rows`` adds ``kept_text``
    and the input row as the struct ``row``.

    A word goes if a window of ``window`` words that covers it also starts in a document of a
    smaller doc_id; windows are judged on the input. Equal texts are judged once: all but the
    smallest doc_id lose every word if they have a full window. Null and empty texts have no
    words. Rows without doc_id have no place in the order: they keep all words and count for
    nobody. Repeated rows of one doc_id do not count against each other. An empty table gives
    an empty result; other columns are ignored.
    """
    part = max(1, window // 2)
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *whole_row)
    docs = docs.withColumn("digest", F.xxhash64(F.lit(7), "text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    spec = "doc_id long, digest long, marks array<long>, places array<int>"
    key = ["doc_id", "digest"]
    slim = known.select(*key, F.md5(F.encode("text", "UTF-8")).alias("md5"))
    leads = slim.groupBy("md5").agg(F.min(F.struct("doc_id", "digest")).alias("lead"), F.max("doc_id").alias("last"))
    copies = materialize(slim.join(leads.where("lead.doc_id < last"), "md5").where("doc_id > lead.doc_id").select(*key).distinct())

    marked = _maybe_in(known, copies)
    single = marked.where("NOT maybe").unionByName(marked.where("maybe").join(copies, key, "left_anti"))
    wide_spec = spec.replace("places", "wides array<long>, places")
    found = materialize(single.select(*key, "text").mapInArrow(_anchors(window, part), wide_spec).where("size(marks) > 0"))
    level = materialize(_repeated(found.mapInArrow(_gather, GROUPS), "mark").drop("mark", "first_doc"))
    edges = level.where("wide IS NULL").withColumn("first_doc", F.lit(None).cast("long"))
    survivors = materialize(_by_text(_repeated(level.where("wide IS NOT NULL"), "wide", "left").unionByName(edges)))

    wider = _maybe_in(known, survivors).where("maybe").join(survivors, key).select(*key, "text", "places", "settled")
    wider = materialize(wider.mapInArrow(_extend(window, part), spec).where("size(marks) > 0"))
    gone = _by_text(_repeated(wider.mapInArrow(_gather, GROUPS), "mark")).select(*key, F.col("settled").alias("places")).where("size(places) > 0")
    gone = gone.unionByName(
        survivors.where("size(settled) > 0").select(*key, F.flatten(F.transform("settled", lambda p: F.sequence(p - (window - part), p))).alias("places")))
    gone = gone.groupBy(*key).agg(F.flatten(F.collect_list("places")).alias("places"))
    verdicts = materialize(gone.withColumn("whole", F.lit(False)).unionByName(
        copies.select(*key, F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("whole"))))

    rows = ["row"] if with_rows else []
    judged = _maybe_in(docs, verdicts)
    same = judged.where("NOT maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(False).alias("whole"), *rows)
    other = judged.where("maybe").join(verdicts, key, "left").select("doc_id", "text", "places", "whole", *rows)
    out = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_rows)
    if with_rows:
        out = out.add("row", docs.schema["row"].dataType)
    return same.unionByName(other).mapInArrow(_finish(window, with_rows), out)
