"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles. ``positions`` minima of 16 bits each form
its signature, cut into chunks of ``chunk`` positions. Two signatures that differ in fewer
than ``2 * positions / chunk`` places differ in at most one place of some chunk (pigeonhole),
so one key per chunk and left-out place finds every such pair. At a similarity of 0.85 and
32 positions that distance is passed with a probability below 1e-5.

Each distinct set is a node. Nodes that share a key meet under the key's smallest node, its
pivot. All of them are compared with the pivot on full sets; those not linked to it are then
compared with all others of the group. Nodes linked to the pivot need no comparison among
themselves: they are connected already. Each group gives a spanning forest, never all pairs.

A group of bounded size does all that in one task. The members of a larger one are dealt into
chunks, and the pivot goes to every chunk: as many rows as members and chunks. Only what is
left unlinked, cut into blocks, then goes to every chunk again to meet all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.common import hash_words, lower_words, mix, ngram_hashes
from marginalia.llm.components import connected_components
from marginalia.session import materialize

#: Shingles that one task compares at once, a chunk of a group or a block of those that ask; larger groups are dealt out.
BLOCK_SHINGLES = 1_000_000


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashed shingles, sorted; with fewer words the whole sequence is one shingle."""
    h = hash_words(lower_words(text))
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else h


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    low = np.full(len(seeds), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[at : at + 2048, None] ^ seeds) * (seeds | np.uint64(1))).min(axis=0))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.int32)


def _features(n: int, positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            sizes, set_a, set_b, signs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                set_a.append(int.from_bytes(digest[:8], "little", signed=True))
                set_b.append(int.from_bytes(digest[8:], "little", signed=True))
                signs.append(signature(s, seeds) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(set_a, pa.int64()),
                 pa.array(set_b, pa.int64()), pa.array(signs, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return run


#: Where a set goes: the group's pivot, a chunk of its members, a block of those that ask, and whether the set asks (0) or answers (1).
MEETS = "struct<pivot:long,chunk:int,block:int,role:int,node:long,mark:long>"


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, n).tobytes() for t in batch.column("text").to_pylist()]
            marks = [int.from_bytes(xxhash.xxh3_128_digest(s)[:8], "little", signed=True) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("meets"), pa.array(marks, pa.int64()), pa.array(found, pa.binary())], names=["meets", "mark", "shingles"])

    return run


def gathered(docs: DataFrame, meets: DataFrame, words: int) -> DataFrame:
    """``pivot, chunk, block, role, node, shingles``, each meeting in one partition, those that ask first.

    ``meets`` has ``rep, set_a, node`` and the place of a meeting. Each text that meets others
    is read once, however many meetings it has; of an id with several texts the right one answers.
    """
    places = meets.groupBy("rep").agg(F.collect_list(
        F.struct("pivot", "chunk", "block", "role", "node", F.col("set_a").alias("mark")).cast(MEETS)).alias("meets"))
    read = docs.join(places, docs.doc_id == places.rep).select("text", "meets")
    rows = read.mapInArrow(_sets(words), f"meets array<{MEETS}>, mark long, shingles binary").select(F.explode("meets").alias("m"), "mark", "shingles")
    rows = rows.where("m.mark = mark").select("m.pivot", "m.chunk", "m.block", "m.role", "m.node", "shingles")
    return rows.repartition("pivot", "chunk", "block").sortWithinPartitions("pivot", "chunk", "block", "role")


class Askers:
    """Sets that ask, as one sorted list of shingles, and what their common members tell."""

    def __init__(self, sets: dict[int, np.ndarray], percent: int) -> None:
        self.nodes, self.percent = list(sets), percent
        self.sizes = np.array([len(s) for s in sets.values()], np.int64)
        flat, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def near(self, shingles: np.ndarray) -> list[int]:
        """Nodes whose sets are near enough to another set."""
        low, high = np.searchsorted(self.flat, shingles), np.searchsorted(self.flat, shingles, side="right")
        n = high - low
        hits = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[hits], minlength=len(self.nodes))
        return [self.nodes[k] for k in np.flatnonzero(100 * common >= self.percent * (self.sizes + len(shingles) - common))]


class Forest:
    """Links that connect what was not connected."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Meetings of a sorted partition, each with its ``(role, node, shingles)``, read as they come."""
    columns = ("pivot", "chunk", "block", "role", "node", "shingles")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    for key, group in groupby(rows, key=lambda row: row[:3]):
        yield key, ((role, node, np.frombuffer(shingles, np.uint64)) for _, _, _, role, node, shingles in group)


def _whole_groups(percent: int):
    """Links of groups that are in one task: with the pivot, then of what is left with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _, _), rows in _meetings(batches):
            sets = {node: shingles for _, node, shingles in rows}
            if len(sets) < 2 or pivot not in sets:
                continue
            forest, asker = Forest(), Askers({pivot: sets[pivot]}, percent)
            left = {node: s for node, s in sets.items() if node != pivot and not asker.near(s)}
            for node in sets.keys() - left.keys():
                forest.join(pivot, node)
            if left:
                asker = Askers(left, percent)
                for node, s in sets.items():
                    for other in asker.near(s):
                        forest.join(other, node)
            yield _edge_batch(forest.links)
        yield _edge_batch([])

    return run


def _asked(percent: int):
    """Links between those that ask and the members of a chunk, which pass one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _meetings(batches):
            forest, asking, asker = Forest(), {}, None
            for role, node, shingles in rows:
                if role == 0:
                    asking[node] = shingles
                    continue
                if asker is None and asking:
                    asker = Askers(asking, percent)
                for other in asker.near(shingles) if asker else ():
                    forest.join(other, node)
            yield _edge_batch(forest.links)
        yield _edge_batch([])

    return run


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def pivot_meetings(groups: DataFrame) -> DataFrame:
    """The members of large groups, each in its chunk, and the pivot in every chunk: a row per member and per chunk."""
    member = groups.withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), nb) AS int)"))
    pivot = groups.where("node = pivot").withColumn("chunk", F.explode(F.expr("sequence(0, CAST(nb AS int) - 1)")))
    return member.withColumn("role", F.lit(1)).unionByName(pivot.withColumn("role", F.lit(0))).withColumn("block", F.lit(0))


def rest_meetings(groups: DataFrame, linked: DataFrame, block_shingles: int) -> DataFrame:
    """Members that their pivot did not link, in blocks, each in every chunk, to meet all members of their group."""
    left = materialize(groups.where("node <> pivot").join(linked, (groups.pivot == linked.a) & (groups.node == linked.b), "left_anti"))
    blocks = materialize(left.groupBy("pivot").agg(F.ceil(F.sum("size") / F.lit(block_shingles)).alias("blocks")))
    asks = left.join(blocks, "pivot").withColumn("block", F.expr("CAST(pmod(xxhash64(node, 1), blocks) AS int)")).withColumn(
        "chunk", F.explode(F.expr("sequence(0, CAST(nb AS int) - 1)"))).withColumn("role", F.lit(0))
    answers = groups.join(blocks, "pivot").withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), nb) AS int)")).withColumn(
        "block", F.explode(F.expr("sequence(0, CAST(blocks AS int) - 1)"))).withColumn("role", F.lit(1))
    return asks.unionByName(answers).drop("blocks")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, positions: int = 40, chunk: int = 4,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Null and empty texts, or texts of white space alone, have an empty set, link with nothing
    and stay. A row without doc_id cannot be named by a component: its component_id is null
    and it stays. Rows of one doc_id with different texts are nodes of their own: each carries
    the component of its own text. Rows that repeat get equal results. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spec = "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"
    features = materialize(docs.mapInArrow(_features(words, positions), spec))
    # written with their numbers, so that a lost part cannot be numbered anew
    classes = materialize(
        features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()))

    keys = [F.xxhash64(F.lit(start + out), *[F.col("sig")[p] for p in range(start, min(start + chunk, positions)) if p != start + out])
            for start in range(0, positions, chunk) for out in range(min(chunk, positions - start))]
    keyed = classes.select("node", "rep", "set_a", "size", F.explode(F.array(*keys)).alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top").drop("top")
    # written first, so that the join shuffles both sides itself and splits a key that very many sets share
    groups = keyed.join(materialize(pivots), "key").select("pivot", "node", "rep", "set_a", "size").distinct()
    groups = materialize(groups)
    chunks = materialize(groups.groupBy("pivot").agg(F.ceil(F.sum("size") / F.lit(block_shingles)).alias("nb")))

    small = groups.join(chunks.where("nb = 1"), "pivot").select(
        "pivot", F.lit(0).alias("chunk"), F.lit(0).alias("block"), F.lit(0).alias("role"), "node", "rep", "set_a")
    edges = gathered(docs, small, words).mapInArrow(_whole_groups(percent), "a long, b long")
    large = chunks.where("nb > 1")
    if not large.isEmpty():
        dealt = materialize(groups.join(large, "pivot"))
        linked = materialize(gathered(docs, pivot_meetings(dealt), words).mapInArrow(_asked(percent), "a long, b long"))
        rest = gathered(docs, rest_meetings(dealt, linked, block_shingles), words).mapInArrow(_asked(percent), "a long, b long")
        edges = edges.unionByName(linked).unionByName(rest)

    labels = connected_components(edges)
    labelled = classes.join(labels.withColumnRenamed("node", "named"), classes.node == F.col("named"), "left").select(
        "set_a", "set_b", "rep", F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("low"))
    named = labelled.join(smallest, "component").select("set_a", "set_b", F.col("low").alias("component"))
    return features.drop("sig").join(named, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
