"""Packing of tokenised documents into sequences of fixed length, by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEPARATOR = 2


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokenizers file sets beside its merges, which a rank file does not hold: whole texts that are never split."""
    import json

    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that match more or less than their own text")
    return {t["content"]: t["id"] for t in found}


def load_encoding(ranks_path: str, pattern: str, added: dict[str, int]):
    """The byte-level vocabulary read as ranks: with its added tokens the same ids as its other form, at several times the speed."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


class OpenBins:
    """At most ``limit`` open bins, keyed by free space; ``free`` has a bit for each space that some bin has."""

    def __init__(self, capacity: int, limit: int, first_id: int) -> None:
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.free, self.at, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece: the open bin that it fills best, else a new one; beyond the limit the fullest closes."""
        fits = self.free >> length
        if fits:
            space = length + ((fits & -fits).bit_length() - 1)
            bin_id = self._take(space)
        else:
            space, bin_id = self.capacity, self.new()
            self.open += 1
        left = space - length
        if left:
            self.at[left].append(bin_id)
            self.free |= 1 << left
            if self.open > self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return bin_id, self.capacity - space

    def _take(self, space: int) -> int:
        bin_id = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        return bin_id


def pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)``: the first piece takes what full ones leave over."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, first)] + [(start, capacity) for start in range(first, len(ids), capacity)]


SPEC = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(ranks_path: str, pattern: str, capacity: int, open_bins: int, with_ids: bool, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding = load_encoding(ranks_path, pattern, added)
        context = TaskContext.get()
        bins = OpenBins(capacity, open_bins, (context.partitionId() if context else 0) << 36)
        names = [c.split()[0] for c in SPEC.split(", ")] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * with_ids]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encoding.encode(text or "", allowed_special="all"), SEPARATOR], "<u4")
                for number, (start, length) in enumerate(pieces(ids, capacity)):
                    part = ids[start : start + length]
                    out.append([doc_id, number, start, length, zlib.crc32(part.tobytes()), 0, 0] + [part.astype(np.int32)] * with_ids)
            # the longest of a batch first: short pieces then fill what is left
            for row in sorted(out, key=lambda r: -r[3]):
                row[5], row[6] = bins.place(row[3])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def best_fit_packing(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, open_bins: int = 1024,
                     with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document: where its ids go, and with ``with_ids`` the ids themselves.

    A document's ids are those of its whole text followed by id 2; only those longer than
    ``capacity`` are cut. ``added`` are tokens beside the rank file, each an id wherever its text stands. Each task packs its own split of the input, batch by batch, with
    ``open_bins`` open sequences, so nothing is shuffled and a lost task is simply run again;
    what a task leaves open at its end is the only cost of the split. Null and empty texts
    give one piece that is just id 2; rows without doc_id are packed like others; repeated
    rows are packed each; no rows give no pieces. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(ranks_path, pattern, capacity, open_bins, with_ids, added or {}), SPEC + ", ids array<int>" * with_ids)
