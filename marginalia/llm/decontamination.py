"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages: windows of ``3 * block`` words, one every ``block`` words,
so an item of up to ``2 * block`` words lies whole in one of them. Longer items are searched
with blocks doubled until they fit, a pass for each size.
A passage is the TF-IDF vector of the benchmark's words in it. A randomised SVD, gathered
over all passages of the corpus and the benchmark items, gives a latent space; passages whose
cosine with an item reaches ``cosine`` there are candidates. A candidate counts if enough of
the item's distinctive words stand in it in the same order (longest common subsequence), or
half of them if the item's end, its answer, is there as well: so paraphrases count too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.common import filter_texts

#: Items that are searched for in one pass over the corpus; more are taken in turns.
BLOCK_ITEMS = 512
#: Words that are in more documents than this share are left to the order check,
#: but for the ``ALWAYS`` rarest of each item.
COMMON, ALWAYS = 0.02, 8
BLOCK, RANK, COSINE = 32, 128, 0.3
ORDER, LOOSE, ANSWER = 0.8, 0.5, 0.5
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Letters and digits, A-Z lower-cased; everything else of ASCII parts words."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def lcs_length(a: list, places: dict, size: int) -> int:
    """Longest common subsequence of ``a`` with a sequence given as bit masks of each word's places."""
    full, row = (1 << size) - 1, (1 << size) - 1
    for w in a:
        m = places.get(w)
        if m:
            u = row & m
            row = (row + u) | (row - u)
    return size - (row & full).bit_count()


def _places(ids: list) -> dict:
    out: dict = {}
    for k, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << k
    return out


#: Bits of a mask; longer sequences are masked in parts, or their masks would grow with the square of their length.
MASK_BITS = 4096


def _parts(ids: list, bits: int = MASK_BITS) -> list[tuple[dict, int]]:
    return [(_places(ids[k : k + bits]), len(ids[k : k + bits])) for k in range(0, len(ids), bits)]


def lcs_of_parts(a: list, parts: list[tuple[dict, int]]) -> int:
    """As ``lcs_length``, of a sequence in parts: what the additions carry over goes on into the next part."""
    if len(parts) == 1:
        return lcs_length(a, *parts[0])
    total, carries = 0, bytearray(len(a))
    for places, size in parts:
        full = row = (1 << size) - 1
        for k, w in enumerate(a):
            m = places.get(w, 0)
            if m or carries[k]:
                u = row & m
                both = row + u + carries[k]
                carries[k] = both >> size
                row = both & full | (row - u)
        total += size - row.bit_count()
    return total


@dataclass
class Item:
    item_id: int
    own: list[int]
    answer: list[int]


def read_items(rows: list[tuple[int, str | None]]) -> tuple[list[Item], dict[bytes, int]]:
    """Items as word ids. The answer is what follows the last question mark or line end, else the last quarter."""
    ids: dict[bytes, int] = {}
    items = []
    for item_id, text in rows:
        own = [ids.setdefault(w, len(ids)) for w in plain_words(text)]
        if not own:
            continue
        tail = plain_words((text or "").rstrip("?\n ").replace("?", "\n").rpartition("\n")[2])
        n = len(tail) if 0 < len(tail) < len(own) else max(1, len(own) // 4)
        items.append(Item(item_id, own, own[-n:]))
    return items, ids


def _document_counts(ids: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(ids) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = {ids.get(w, -1) for w in set(plain_words(text))}
                seen[[i for i in found if i >= 0]] += 1
                n += 1
        seen[-1] = n  # the last row counts documents
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(seen[rows])], names=["word", "n"])

    return run


@dataclass
class Space:
    """Weights of all benchmark words and what places a passage in the latent space."""

    ids: dict[bytes, int]
    items: list[Item]
    column: np.ndarray  # word id to column, -1 if it is too common
    weight: np.ndarray  # by column
    block: int
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None  # of the items

    def columns(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of a text, -1 if unknown, and their columns."""
        words = plain_words(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        return ids, np.where(ids >= 0, self.column[ids], -1)


def _weigh(items: list[Item], ids: dict[bytes, int], seen: np.ndarray, n: int, block: int) -> Space:
    idf = np.log1p(n / np.maximum(seen, 0.5))
    keep = seen <= COMMON * n
    for item in items:
        rarest = sorted(set(item.own), key=lambda w: (seen[w], w))[:ALWAYS]
        keep[rarest] = True
    column = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
    return Space(ids, items, column, idf[keep].astype(np.float32), block)


def _item_matrix(space: Space) -> np.ndarray:
    out = np.zeros((len(space.items), len(space.weight)), np.float32)
    for k, item in enumerate(space.items):
        c = space.column[item.own]
        np.add.at(out[k], c[c >= 0], space.weight[c[c >= 0]])
    return out


def _block_rows(columns: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(columns >= 0)
    return at // block, columns[at]


def _sketch(space: Space, test: np.ndarray, block: int):
    """Sums of ``a^T (a test)`` over the passages ``a`` of a task, and their squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, norm = np.zeros(test.shape, np.float32), 0.0
        weighted = test * space.weight[:, None]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        before = size = 0

        def add() -> None:
            nonlocal norm
            if held:
                r, k = (np.concatenate(x) for x in zip(*held))
                held.clear()
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                sums = np.add.reduceat(weighted[k], starts, axis=0)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
                order = np.argsort(k, kind="stable")
                own, first = np.unique(k[order], return_index=True)
                total[own] += np.add.reduceat(sums[passage[order]], first, axis=0) * space.weight[own, None]
                norm += float((space.weight[k] ** 2).sum())

        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows, c = _block_rows(space.columns(text)[1], block)
                if not len(c):
                    continue
                held.append((rows + before, c))
                before += int(rows[-1]) + 1
                size += len(c)
                if size > 16384:
                    add()
                    before = size = 0
        add()
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        for at in range(0, len(rows), 1024):
            own = rows[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total[own].astype(np.float64)), pa.list_(pa.float64()))], names=["row", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([[norm] + [0.0] * (test.shape[1] - 1)], pa.list_(pa.float64()))], names=["row", "sums"])

    return run


def _latent_space(texts: DataFrame, space: Space, rank: int) -> Space:
    """Randomised SVD of all passages and the items: one pass multiplies by ``A^T A``, the rest is of the benchmark's size.

    The items weigh as much as the whole corpus, or the space would follow frequent words and not them.
    """
    items = _item_matrix(space)
    rank = min(rank, len(space.weight))
    test = np.random.default_rng(3).standard_normal((len(space.weight), rank)).astype(np.float32)
    parts = texts.mapInArrow(_sketch(space, test, space.block), "row long, sums array<double>")
    total, norm = np.zeros(test.shape), 0.0
    for r in parts.groupBy("row").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(rank)]).collect():
        if r[0] < 0:
            norm = r[1]
        else:
            total[r[0]] = r[1:]
    boost = max(norm, 1.0) / max(float((items**2).sum()), 1e-9)
    total += boost * (items.T @ (items @ test))
    inner = test.T @ total
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-7 * values.max()
    half = total @ (vectors[:, good] / np.sqrt(values[good]))  # half half^T approximates A^T A
    basis, strength, _ = np.linalg.svd(half, full_matrices=False)
    space.basis = basis[:, strength > 1e-6 * strength.max()].astype(np.float32)
    latent = items @ space.basis
    space.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return space


class Finder:
    """Looks one text up: candidates by cosine, then order and answer checks."""

    def __init__(self, space: Space, cosine: float) -> None:
        self.space, self.block, self.cosine = space, space.block, cosine
        rare = lambda own: [w for w in own if space.column[w] >= 0]
        self.rare = [rare(i.own) for i in space.items]
        self.answer = [rare(i.answer) or i.answer for i in space.items]
        # a passage with fewer distinctive words passes the order check for no item
        self.least = max(1, min(int(np.ceil(LOOSE * len(set(r)))) for r in self.rare))
        self.words = [set(r) for r in self.rare]
        self.masks = [(_parts(r), _parts(a), _parts(i.own)) for r, a, i in zip(self.rare, self.answer, space.items)]
        self.step = max(1, 8192 // self.block)  # blocks that are summed at once

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """``(item_id, cosine, words in order, item's words)`` of each item that is in the text."""
        space, block = self.space, self.block
        ids, columns = space.columns(text)
        rows, c = _block_rows(columns, block)
        found: dict[int, tuple[float, int]] = {}
        if not len(c):
            return []
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sums = np.zeros((len(ids) // block + 3, space.basis.shape[1]), np.float32)
        for at in range(0, len(starts), self.step):
            lo, hi = starts[at], starts[at + self.step] if at + self.step < len(starts) else len(c)
            part = space.basis[c[lo:hi]] * space.weight[c[lo:hi], None]
            sums[rows[starts[at : at + self.step]]] = np.add.reduceat(part, starts[at : at + self.step] - lo, axis=0)
        held = np.bincount(rows, minlength=len(sums))
        worth = np.flatnonzero(held[:-2] + held[1:-1] + held[2:] >= self.least)
        for at in range(0, len(worth), 256):
            own = worth[at : at + 256]
            w = sums[own] + sums[own + 1] + sums[own + 2]
            near = (w @ space.latent.T) / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
            for k, i in zip(*np.nonzero(near >= self.cosine)):
                span = slice(int(own[k]) * block, (int(own[k]) + 3) * block)
                length = self._check(ids[span], columns[span], int(i))
                if length:
                    found[int(i)] = max(found.get(int(i), (0.0, 0)), (float(near[k, i]), length))
        return [(space.items[i].item_id, cos, n, len(space.items[i].own)) for i, (cos, n) in sorted(found.items())]

    def _check(self, ids: np.ndarray, columns: np.ndarray, i: int) -> int:
        rare, words, (of_rare, of_answer, of_all) = self.rare[i], self.words[i], self.masks[i]
        own = ids[columns >= 0].tolist()
        if len(rare) and sum(w in words for w in set(own)) < LOOSE * len(words):
            return 0
        all_words = ids[ids >= 0].tolist()
        length = lcs_of_parts(all_words, of_all)
        share = lcs_of_parts(own, of_rare) / len(rare) if rare else 0.0
        if share < LOOSE or length < LOOSE * len(self.space.items[i].own):
            return 0
        if share >= ORDER:
            return length
        answered = lcs_of_parts(all_words, of_answer) / len(self.answer[i])
        return length if answered >= ANSWER else 0


def _pairs(space: Space, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(space, cosine)
        for batch in batches:
            out = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in find(t)]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "cosine", "in_order", "item_words"])

    return run


def build_spaces(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, rank: int = RANK, block: int = BLOCK) -> list[Space]:
    """A latent space per ``block_items`` benchmark items; each is of the items' size, whatever the corpus.

    Items of more than ``2 * block`` words have spaces of their own, with the block doubled until
    they fit, and fewer items each: no more words than ``block_items`` short items can have.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL").orderBy("item_id", "text")
    spaces: list[Space] = []
    held: dict[int, list[tuple[int, str | None]]] = {}
    words: dict[int, int] = {}

    def build(size: int) -> None:
        items, ids = read_items(held.pop(size))
        words.pop(size)
        if not items:
            return
        counts = texts.mapInArrow(_document_counts(ids), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        seen = np.zeros(len(ids) + 1)
        for r in counts:
            seen[r.word] = r.n
        if not seen[-1]:  # no documents
            return
        spaces.append(_latent_space(texts, _weigh(items, ids, seen[:-1], int(seen[-1]), size), rank))

    for row in rows.toLocalIterator():
        n, size = len(plain_words(row.text)), block
        while n > 2 * size:
            size *= 2
        if held.get(size) and words[size] + n > 2 * block * block_items:
            build(size)
        held.setdefault(size, []).append((row.item_id, row.text))
        words[size] = words.get(size, 0) + n
        if len(held[size]) == block_items:
            build(size)
    for size in sorted(held):
        build(size)
    return spaces


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, rank: int = RANK, block: int = BLOCK,
                       cosine: float = COSINE) -> DataFrame:
    """``(doc_id, item_id, cosine, in_order, item_words)``: each document with each benchmark item found in it.

    Whole texts are searched for every item. Null and empty texts, and items without words,
    match nothing; items without id are left out. Rows without doc_id and repeated rows are
    searched like others; items with equal texts each match. Empty tables give an empty
    result; other columns are ignored. Items may have any length: up to ``2 * block`` words
    they share their passes over the corpus, longer ones take passes of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spec = "doc_id long, item_id long, cosine double, in_order int, item_words int"
    found = docs.sparkSession.createDataFrame([], spec)
    for space in build_spaces(docs, benchmark, block_items, rank, block):
        found = found.unionByName(docs.mapInArrow(_pairs(space, cosine), spec))
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, rank: int = RANK, block: int = BLOCK,
                    cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found.

    Null and empty texts hold none and stay; without benchmark items all rows stay. The spaces,
    of the benchmark's size, are broadcast once to each executor.
    """
    spaces = build_spaces(docs, benchmark, block_items, rank, block)
    if not spaces:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(spaces)

    def test() -> Callable[[list[str | None]], list[bool]]:
        finders = [Finder(s, cosine) for s in held.value]
        return lambda texts: [not any(f(t) for f in finders) for t in texts]

    return filter_texts(docs, test)
