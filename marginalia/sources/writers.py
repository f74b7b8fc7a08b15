"""Writers: JSON lines, request shards, reports and flat tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.session import broadcast_if_small, materialize

# Request file limit and the columns of the error tables.
MAX_SHARD_BYTES = 200 * 1024 * 1024
FIELD_ERROR_COLUMNS = ("path", "tp", "tn", "fp", "fn", "support", "accuracy", "error_rate")
WORST_COLUMNS = (
    "rank", "nota_id", "f1", "tp", "fp", "fn", "gold_leaves", "pred_leaves", "gold_total", "pred_total", "gold_tiene",
    "pred_tiene", "finish_reason", "output_tokens",
)
BLOCK_ROWS = 100_000
MAX_BLOCKS = 200_000


def json_line(*columns: str | Column) -> Column:
    """One compact JSON object; nulls and non-ASCII text are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", line: Column | None = None) -> None:
    """JSON lines, one object per row; ``mode='append'`` for incremental output."""
    text = json_line(*df.columns) if line is None else line
    df.select(text.alias("value")).write.mode(mode).text(path)


def sink_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small summary document: the input has one row per report block."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def sink_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    df.select(*columns).write.mode(mode).option("emptyValue", "").csv(path, header=True)


def sink_wide_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', quoteAll=True)
    writer.format(fmt).save(path)


def _block(order: str) -> Column:
    return F.floor(F.col(order) / BLOCK_ROWS).cast("long")


def shard_borders(lines: DataFrame, line: str, order: str, cap: int) -> DataFrame:
    """``__block, __cuts``: per block of rows, where in ``order`` each of its shards begins.

    Sums run on two levels, over blocks and inside a block, and only over row numbers and byte
    counts. A row's shard follows from the bytes before it: with shards of ``cap`` minus the
    largest row, the row that crosses a border still fits.
    """
    sized = lines.select(_block(order).alias("__block"), F.col(order).alias("__at"), (F.octet_length(line) + 1).cast("long").alias("__bytes"))
    blocks = materialize(sized.groupBy("__block").agg(F.sum("__bytes").alias("__sum"), F.max("__bytes").alias("__max")))
    largest = blocks.agg(F.max("__max")).first()[0] or 0
    if largest > cap:
        raise ValueError(f"a single row exceeds {cap} bytes")
    earlier = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("__bytes").over(inside), F.lit(0))
    placed = sized.join(broadcast_if_small(offsets, MAX_BLOCKS), "__block").withColumn("shard", F.floor(start / max(cap - largest, 1)).cast("long"))
    cuts = placed.groupBy("__block", "shard").agg(F.min("__at").alias("low"))
    return cuts.groupBy("__block").agg(F.sort_array(F.collect_list(F.struct("low", "shard"))).alias("__cuts"))


def shard_ids(lines: DataFrame, line: str, order: str, cap: int = MAX_SHARD_BYTES) -> DataFrame:
    """Adds ``shard`` and ``bytes`` so that no shard file exceeds ``cap`` bytes, in row order.

    ``order`` is the dense row index. The lines themselves are not shuffled: each looks its
    shard up among the few that its block of rows has. A single row above the cap is an error.
    """
    borders = broadcast_if_small(materialize(shard_borders(lines, line, order, cap)), MAX_BLOCKS)
    shard = F.expr(f"element_at(filter(__cuts, c -> c.low <= `{order}`), -1).shard")
    return lines.withColumn("__block", _block(order)).join(borders, "__block").withColumns(
        {"shard": shard, "bytes": (F.octet_length(line) + 1).cast("long")}).drop("__block", "__cuts")


def ordered_shards(lines: DataFrame, line: str, order: str, cap: int = MAX_SHARD_BYTES) -> DataFrame:
    """``shard, value``, each shard in one partition in row order: the one shuffle of the lines."""
    sharded = shard_ids(lines, line, order, cap).select("shard", order, F.col(line).alias("value"))
    return sharded.repartition("shard").sortWithinPartitions("shard", order).select("shard", "value")


def sink_request_shards(lines: DataFrame, path: str, line: str, order: str, cap: int = MAX_SHARD_BYTES) -> None:
    """One folder per shard; each shard is written by one task in row order."""
    ordered_shards(lines, line, order, cap).write.partitionBy("shard").text(path)
