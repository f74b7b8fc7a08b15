"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard owns ``vnodes`` places on a ring; a row belongs to the next place clockwise of its
own hash. A shard holds at most its share: rows that find it full go on clockwise to the next
place whose shard has room. Rows are counted per stretch of the ring, each within one arc, so
which rows an arc passes on is known from counts alone: the driver sees one number per arc,
never rows. Where a row stands on the ring, and whose arc that is, follows from its id and the
shards alone, whatever the size of the table.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marginalia.llm.common import stored
from marginalia.session import materialize

#: The ring has 2 ** RING_BITS positions. It is counted in 2 ** CELL_BITS cells, which are cut where a place stands.
RING_BITS, CELL_BITS = 48, 12
#: Rows of one stretch of the ring are dealt into so many parts, so that no position is one task's.
PARTS = 256


def ring_places(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of every virtual node, clockwise; a shard's places do not depend on the number of shards."""
    places: dict[int, int] = {}
    for shard in range(shards):
        for k in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"{shard}:{k}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
            while at in places:  # two virtual nodes never share a position
                at = (at + 1) % (1 << RING_BITS)
            places[at] = shard
    return sorted(places.items())


def segments(positions: list[int]) -> list[dict]:
    """The ring as stretches ``first <= position < end`` that lie in one cell and one arc, clockwise from the last place.

    A position belongs to the arc of the next place at or behind it; the places cut the cells, so
    that every place has its own arc, however close the next one is.
    """
    size, cell = 1 << RING_BITS, RING_BITS - CELL_BITS
    cuts = sorted({0, *range(0, size, 1 << cell), *[p + 1 for p in positions if p + 1 < size]}) + [size]
    out = [{"cell": first >> cell, "first": first, "end": end, "arc": bisect.bisect_left(positions, first) % len(positions)} for first, end in zip(cuts, cuts[1:])]
    start = next((k for k, s in enumerate(out) if s["first"] > positions[-1]), 0)
    return [s | {"turn": n} for n, s in enumerate(out[start:] + out[:start])]


def fill(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where each arc's rows go: ``(arc, first rank, end rank, shard, first slot)``.

    All arcs offer what they have to their own shard, then what is left to the next place
    clockwise, and so on; ``capacity`` must have room for all.
    """
    room, used = list(capacity), [0] * len(capacity)
    left = [(arc, 0, n) for arc, n in enumerate(counts) if n]
    out, step = [], 0
    while left:
        rest = []
        for arc, start, end in left:
            shard = owners[(arc + step) % len(owners)]
            take = min(room[shard], end - start)
            if take:
                out.append((arc, start, start + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if start + take < end:
                rest.append((arc, start + take, end))
        left, step = rest, step + 1
        if step > len(owners):
            raise ValueError("the shards have less room than there are rows")
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Room per shard: without slack just the rows, dealt so that two shards differ by one at most."""
    if slack <= 0:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [math.ceil(round((1 + slack) * rows / shards, 6))] * shards


def _literal(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table written into the plan; its size follows the ring, not the data."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def shard_rows(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0, text_size: Column | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``.

    Law ``rows``: with ``slack`` 0 the shards' row counts are at most one apart; with slack no
    shard holds more than ``1 + slack`` times its share and fewer rows move when shards are
    added. Slots are gapless from 0 in each shard. Size is the text's UTF-8 bytes plus 16; a
    null text counts as empty. Rows without doc_id find their place by their text. Repeated
    rows get a place each. An empty table gives an empty result. Other columns are ignored.
    Only ids, sizes and checksums are written and shuffled, once, by stretch of the ring and a
    part of its rows, so that rows that share a position, as repeated ids do, are not one task's.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 16 if text_size is None else text_size.cast("long")).alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    # rows of one key share a position; written with their parts, so that both passes see the same ones
    slim = stored(slim.withColumn("ring", F.shiftrightunsigned(key, 64 - RING_BITS)).withColumn(
        "part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")))
    places = ring_places(shards, vnodes)
    ring = segments([at for at, _ in places])
    by_cell: dict[int, list[dict]] = {}
    for s in ring:
        by_cell.setdefault(s["cell"], []).append({"first": s["first"], "turn": s["turn"]})
    cells = F.broadcast(_literal(spark, [{"cell": c, "cuts": sorted(cuts, key=lambda x: x["first"])} for c, cuts in by_cell.items()],
                                 "cell:long,cuts:array<struct<first:long,turn:int>>"))
    # a row's stretch is the last one of its cell that begins at or before it
    turn = F.expr("element_at(filter(cuts, c -> c.first <= ring), -1).turn")
    placed = slim.withColumn("cell", F.shiftright("ring", RING_BITS - CELL_BITS)).join(cells, "cell").withColumn("turn", turn).drop("cuts", "cell")

    counts = materialize(placed.groupBy("turn", "part").agg(F.count("*").alias("n")))  # at most PARTS numbers per stretch
    arcs = _literal(spark, [{"turn": s["turn"], "arc": s["arc"]} for s in ring], "turn:int,arc:int")
    clockwise = Window.partitionBy("arc").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(arcs), "turn").withColumn("before", F.coalesce(F.sum("n").over(clockwise), F.lit(0)))
    per_arc = {r.arc: r.n for r in starts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one number per place of the ring

    plan = fill([per_arc.get(arc, 0) for arc in range(len(places))], [shard for _, shard in places], capacities(sum(per_arc.values()), shards, slack))
    moves = _literal(spark, [dict(zip(("arc", "first", "end", "shard", "slot0"), p)) for p in plan], "arc:int,first:long,end:long,shard:int,slot0:long")

    inside = Window.partitionBy("turn", "part").orderBy("ring", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts.select("turn", "part", "arc", "before"), ["turn", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    # the moves are a few per place of the ring, whatever the table
    placed = ranked.join(F.broadcast(moves), (ranked.arc == moves.arc) & (ranked["rank"] >= moves["first"]) & (ranked["rank"] < moves["end"]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
