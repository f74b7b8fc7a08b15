"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide counts of linked id pairs.

Both tokenizers read the whole text. Where a token of each ends at the same byte and both next
tokens begin with a space, the document is cut: between two such anchors lies a window, a tuple
of ids of A and one of B. Windows repeat as words do, so a window is aligned once and kept by its
id tuples. Any shared end separates links, so windows without a space inside are cut at further
shared ends once they grow long.

Every document is read once and leaves its distinct linked pairs with their numbers. Counts of
pairs are sums over all documents. A pair that makes up at least one in ``HEAVY`` of all links is
one of at most ``HEAVY`` such pairs; these are broadcast. All others are joined by shuffle, where
no key can be hot, for the same reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.common import parts, stored
from marginalia.llm.packing import load_encoding

#: Pairs with at least this share of all links, one in so many, are broadcast: never more than this number of rows.
HEAVY = 1 << 16
#: Text bytes that are tokenised and aligned at once; a longer text is alone.
BYTES = 1 << 18
#: Tokens of one side from which a window is cut at all its shared ends.
LONG = 32
#: Windows kept; beyond it all are forgotten and learnt anew.
WINDOWS = 300_000
#: Stands between the ids of A and of B in a window's tuple; no id is as large.
MARK = 0xFFFF

SPEC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def piece_vocabulary(model) -> list[bytes]:
    """Bytes of every id of a sentence-piece vocabulary: U+2581 is a space, ``<0xHH>`` one byte; control ids have none."""

    def one(number: int) -> bytes:
        if model.is_byte(number):
            return bytes([int(model.id_to_piece(number)[3:5], 16)])
        if model.is_control(number) or model.is_unknown(number):
            return b""
        return model.id_to_piece(number).replace("▁", " ").encode("utf-8")

    return [one(number) for number in range(model.vocab_size())]


class Vocabulary:
    """Bytes of the ids of one tokenizer."""

    def __init__(self, tokens: list[bytes]) -> None:
        if len(tokens) >= 1 << 16:
            raise ValueError("ids of more than 16 bits: a pair would need a wider column")
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.space = np.array([t[:1] == b" " for t in tokens])
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._start = np.cumsum(self.length) - self.length

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of some ids, one after the other."""
        length = self.length[ids]
        ends = np.cumsum(length)
        return self._bytes[np.repeat(self._start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def faithful(texts: list[bytes], ids: list[np.ndarray], vocabulary: Vocabulary) -> np.ndarray:
    """Whether the ids of each text spell it."""
    same = np.array([vocabulary.length[i].sum() == len(t) for t, i in zip(texts, ids)], bool)
    at = np.flatnonzero(same)
    if len(at):
        spelt = vocabulary.spell(np.concatenate([ids[k] for k in at]))
        differs = spelt != np.frombuffer(b"".join([texts[k] for k in at]), np.uint8)
        ends = np.cumsum([len(texts[k]) for k in at])
        wrong = np.diff(np.concatenate([[0], np.cumsum(differs)])[ends], prepend=0)
        same[at[wrong > 0]] = False
    return same


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every end of either side closes a stretch of bytes of one token each: their places in A and B, and whether both end there."""
    marks = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] |= 2
    marks = marks[marks > 0]
    a_end, b_end = marks & 1, marks >> 1
    return np.cumsum(a_end, dtype=np.int64) - a_end, np.cumsum(b_end, dtype=np.int64) - b_end, marks == 3


def window_ends(a_after: np.ndarray, b_after: np.ndarray, a_space: np.ndarray, b_space: np.ndarray,
                last: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which shared ends close a window. ``after`` are the places behind them, ``space`` tells of each token whether it
    begins with a space, ``last`` of each shared end whether it closes a document."""
    anchor = last.copy()
    inner = ~anchor
    anchor[inner] = a_space[a_after[inner]] & b_space[b_after[inner]]
    window = np.concatenate([[0], np.cumsum(anchor)[:-1]])
    lengths = np.maximum(np.diff(a_after[anchor], prepend=0), np.diff(b_after[anchor], prepend=0))
    return anchor | (lengths > long)[window]


def interleave(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch by stretch what A has up to ``a_stop`` and B up to ``b_stop``, and where each stretch ends."""
    out = np.empty(len(a) + len(b), np.result_type(a, b))
    a_n, b_n = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    out[np.arange(len(a)) + np.repeat(b_stop - b_n, a_n)] = a
    out[np.arange(len(b)) + np.repeat(a_stop, b_n)] = b
    return out, a_stop + b_stop


def group_pieces(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Numbers of the pieces of the groups' text in order: two of each id of A, it closes its side of a group or not, then those of B."""
    pieces = [2 * a.astype(np.int64), 2 * b.astype(np.int64) + (2 << 16)]
    for piece, stop in zip(pieces, (a_stop, b_stop)):
        piece[stop - 1] += 1
    return interleave(*pieces, a_stop, b_stop)[0]


def piece_texts() -> list[str]:
    """Texts of the numbers of ``group_pieces``."""
    return [f"{number}{mark}" for closing in "|;" for number in range(1 << 16) for mark in (",", closing)]


def _aligned(a_ranks: str, pattern: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoding = load_encoding(a_ranks, pattern, {})
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_words = Vocabulary([encoding.decode_single_token_bytes(number) for number in range(encoding.n_vocab)])
        b_words = Vocabulary(piece_vocabulary(model))
        shown = piece_texts()
        windows: dict[bytes, str] = {}  # alignment of a window by its ids of A, a mark and its ids of B, 16 bits each

        def one(rows: list[tuple]) -> pa.RecordBatch:
            out = [[doc_id, 0, 0, 0, 0, "", None, None] for doc_id, _ in rows]
            at = [k for k, (_, text) in enumerate(rows) if text]
            if not at:
                return _batch(out)
            texts = [(" " + rows[k][1]).encode("utf-8") for k in at]
            a_all = [np.array(encoding.encode_ordinary(" " + rows[k][1]), np.int64) for k in at]
            b_all = [np.array(ids, np.int64) for ids in model.encode([rows[k][1] for k in at], num_threads=1)]
            good = np.flatnonzero(faithful(texts, a_all, a_words) & faithful(texts, b_all, b_words)).tolist()
            if not good:
                return _batch(out)
            # one after the other the documents are one long text: each ends at a shared end
            a, b = np.concatenate([a_all[k] for k in good]), np.concatenate([b_all[k] for k in good])
            a_ends, b_ends, doc_ends = np.cumsum(a_words.length[a]), np.cumsum(b_words.length[b]), np.cumsum([len(texts[k]) for k in good])
            in_a, in_b, shared = overlaps(a_ends, b_ends)
            pairs = a[in_a].astype(np.uint32) << 16 | b[in_b].astype(np.uint32)
            a_stop, b_stop = in_a[shared] + 1, in_b[shared] + 1
            shared_ends = a_ends[a_stop - 1]
            cut = window_ends(a_stop, b_stop, a_words.space[a], b_words.space[b], np.isin(shared_ends, doc_ends))

            # id tuples of the windows: their ids of A, a mark, their ids of B
            a_cut, b_cut = a_stop[cut], b_stop[cut]
            marked = np.insert(a, a_cut, MARK)
            keys, stops = interleave(marked, b, a_cut + np.arange(1, len(a_cut) + 1), b_cut)
            raw, ends = keys.astype(np.uint16).tobytes(), (2 * stops).tolist()
            tuples = [raw[s:e] for s, e in zip([0, *ends], ends)]
            aligned = list(map(windows.get, tuples))
            fresh = {tuples[w]: w for w, text in enumerate(aligned) if text is None}
            if fresh:
                pieces = group_pieces(a, b, a_stop, b_stop)
                ends = (a_cut + b_cut).tolist()
                for window, w in fresh.items():
                    numbers = pieces[ends[w - 1] if w else 0 : ends[w]].tolist()
                    windows[window] = "".join([shown[n] for n in numbers])[:-1]
                aligned = list(map(windows.get, tuples))

            stops = {  # per document, how many of each end up to its end
                "groups": np.searchsorted(shared_ends, doc_ends, side="right"),
                "windows": np.searchsorted(shared_ends[cut], doc_ends, side="right"),
                "links": np.flatnonzero(shared)[np.searchsorted(shared_ends, doc_ends)] + 1,
            }
            starts = {name: [0, *stop[:-1].tolist()] for name, stop in stops.items()}
            for n, k in enumerate(good):
                (groups, windowed, links) = (slice(starts[name][n], int(stop[n])) for name, stop in stops.items())
                found, times = np.unique(pairs[links], return_counts=True)
                digest = hashlib.sha256(";".join(aligned[windowed]).encode("ascii")).hexdigest()
                out[at[k]][1:] = [len(a_all[k]), len(b_all[k]), groups.stop - groups.start, links.stop - links.start, digest,
                                  found.view(np.int32), times.astype(np.int32)]
            if len(windows) > WINDOWS:
                windows.clear()
            return _batch(out)

        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for some in parts(rows, lambda r: len(r[1] or "") + 16, BYTES):
                yield one(some)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    types = [*[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 2]
    names = [c.split()[0] for c in SPEC.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, links, best)``: links of each id pair over all documents, and whether no pair of the same id of B has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = stored(links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum(F.col("l.times").cast("long")).alias("links")))
    most = counts.groupBy(F.expr("pair & 65535").alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, F.expr("pair & 65535") == most.b).select("pair", "links", F.expr("CAST(links = most AS int)").alias("best"))


def align_tokenizers(docs: DataFrame, a_ranks: str, pattern: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs`` (``doc_id``, ``text``).

    A is a byte-level vocabulary in rank form, with the pattern that parts its words, and reads a
    space and the text; B is a ``sentencepiece`` model that adds this space itself. Special tokens inside texts are plain text. A text that is
    null or empty, or whose bytes one tokenizer does not keep, has no tokens: zeros and an empty
    digest, and no part in the counts. Rows that repeat, with or without doc_id, each count.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = stored(docs.mapInArrow(_aligned(a_ranks, pattern, b_path), SPEC).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(aligned))
    least = -(-(counts.agg(F.sum("links")).first()[0] or 0) // heavy)
    often, seldom = counts.where(F.col("links") >= least), counts.where(F.col("links") < least)

    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    marked = links.join(F.broadcast(often), "pair", "left")
    sums = [F.sum(F.expr("times * best")).alias("n_best"), F.sum(F.expr("times * links")).alias("count_sum")]
    by_often = marked.where("links IS NOT NULL").groupBy("row").agg(*sums)
    by_seldom = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair").groupBy("row").agg(*sums)
    total = by_often.unionByName(by_seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
