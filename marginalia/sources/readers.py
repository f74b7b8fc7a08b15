"""Readers for note tables, JSON lines, manifests and gold rows."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions.text import normalize_cell, strip
from marginalia.session import broadcast_if_small, materialize, once

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_SPLITS = 200_000


def number_rows(scan: DataFrame, name: str = "line_no", start: int = 1, per_file: bool = True) -> DataFrame:
    """Adds the physical row number of a file scan, without sorting the rows.

    A task reads its file splits one after the other, so the position inside a split is an
    id difference. A counting pass gives the rows before each split, one row per split, which
    are kept; the scan itself adds that offset.
    """
    rows = scan.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = materialize(rows.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")))
    order = (Window.partitionBy("__file") if per_file else Window.partitionBy(F.lit(0))).orderBy("__file", "__block")
    before = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    numbered = rows.join(broadcast_if_small(offsets, MAX_SPLITS), ["__file", "__block"])
    return numbered.withColumn(name, F.col("__id") - F.col("__first") + F.col("__before") + start).drop(
        "__file", "__block", "__id", "__first", "__before"
    )


# --- CSV whose quoted cells span lines, read by many tasks ----------------------------

SPLIT = "file string, block long, quotes long, starts_outside long, starts_inside long, utf8 boolean"
PIECE = "file string, number long, block long, whole boolean, piece binary"


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file split: quotes, records that begin in it if it starts outside a quoted cell, or inside one, valid UTF-8."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for file, block, line in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "line")]):
            split = found.setdefault((file, block), [0, 0, 0, True])
            if not _blank(line):  # a blank line begins no record, but inside a cell it is text
                split[1 + split[0] % 2] += 1
            split[0] += line.count(b'"')
            if split[3] and not line.isascii():
                try:
                    line.decode("utf-8")
                except UnicodeDecodeError:
                    split[3] = False
    rows = [(*place, *split) for place, split in found.items()]
    types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in SPLIT.split(", ")])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in a split as a whole; of one cut by a split's border, its lines as a piece."""
    names, types = [c.split()[0] for c in PIECE.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    place, number, inside, held, begun = None, 0, False, [], False

    def done(whole: bool) -> list[tuple]:
        return [(*place[:1], number, place[1], whole, b"\n".join(held))] if held else []

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "line", "inside", "before")]
        for file, block, line, split_inside, before in zip(*columns):
            if (file, block) != place:
                out += done(False)
                # lines before the first record of a split belong to the last one before it
                place, number, inside, held, begun = (file, block), before - 1, split_inside, [], False
            if not inside:
                if _blank(line):
                    continue
                number, held, begun = number + 1, [], True
            held.append(line)
            inside ^= line.count(b'"') % 2 == 1
            if not inside:
                out += done(begun)
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
    out = done(False)
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A CSV with header, all cells as text, plus its dense ``row_index`` in file order.

    Quoted cells may span lines, and yet many tasks read one file. Quotes must stand as the
    format has them: around a whole cell, doubled inside. Then each quote flips between outside
    and inside of a cell. One pass counts, per file split, the quotes and the records that
    begin in it under either state at its start, and tests for UTF-8; a running sum over the
    splits gives each its true state and its first record's number. The second pass cuts the
    records. Only lines of a record that crosses a border of splits are gathered, by record.

    Every file has a header; the first one names the columns. Blank lines between records are
    skipped. Without ``encoding`` the input is UTF-8 if all of it is valid, else Latin-1.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))
    splits = materialize(lines.mapInArrow(_splits, SPLIT))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file")
    stated = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(in_file) % 2 == 1, F.lit(False)))
    counted = stated.withColumn("starts", F.when(F.col("inside"), F.col("starts_inside")).otherwise(F.col("starts_outside")))
    placed = counted.withColumn("before", F.coalesce(F.sum("starts").over(in_file), F.lit(0))).withColumn("total", F.sum("starts").over(whole_file))
    files = placed.groupBy("file").agg(F.greatest(F.max("total") - 1, F.lit(0)).alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = materialize(files.withColumn("rows_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))))
    states = materialize(placed.select("file", "block", "inside", "before"))
    if encoding is None:
        valid = splits.agg(F.coalesce(F.min("utf8"), F.lit(True))).first()[0]
        encoding = "UTF-8" if valid else "ISO-8859-1"

    stated_lines = lines.join(broadcast_if_small(states, MAX_SPLITS), ["file", "block"])
    if states.limit(MAX_SPLITS + 1).count() > MAX_SPLITS:
        stated_lines = stated_lines.repartition("file", "block").sortWithinPartitions("file", "block", "id")  # that join shuffles
    pieces = stated_lines.select("file", "block", "line", "inside", "before").mapInArrow(_records, PIECE)
    whole = pieces.where("whole").select("file", "number", F.col("piece").alias("record"))
    joined = pieces.where(~F.col("whole")).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"))
    # binary pieces keep the bytes of a character that no border of lines can cut
    cut = joined.select("file", "number", F.expr("aggregate(p, CAST(NULL AS BINARY), (a, x) -> CASE WHEN a IS NULL THEN x.piece ELSE concat(a, X'0A', x.piece) END)").alias("record"))
    records = whole.unionByName(cut)
    shown = F.regexp_replace(F.decode("record", encoding), r"\r$", "")
    if encoding == "UTF-8":
        shown = F.when(F.col("number") == 0, F.regexp_replace(shown, "^\ufeff", "")).otherwise(shown)
    records = records.select("file", "number", shown.alias("record"))

    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    head = records.where("number = 0").orderBy("file").limit(1).select("record").first()
    if head is None:
        return spark.createDataFrame([], "row_index long")
    names = [c or f"_c{k}" for k, c in enumerate(next(csv.reader(io.StringIO(head.record), strict=False)))]
    if len(names) > len(set(names)):
        raise ValueError(f"columns that share a name: {names}")
    cells = F.from_csv("record", ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names), options)
    rows = records.where("number > 0").join(broadcast_if_small(files.select("file", "rows_before"), MAX_SPLITS), "file")
    return rows.select(cells.alias("c"), (F.col("rows_before") + F.col("number") - 1).alias("row_index")).select("c.*", "row_index")


def scan_lines(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """``file, line_no, line`` of the non-blank lines; numbers count physical lines of each file, or of all files by path."""
    scan = number_rows(spark.read.text(path).select("value", "_metadata"), per_file=per_file)
    lines = scan.select(F.col("_metadata.file_path").alias("file"), "line_no", strip(F.col("value")).alias("line"))
    return lines.where(F.length("line") > 0)


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``v``, the parsed line, or null if it is not JSON. Duplicate keys count as not JSON."""
    return once(lines, v=F.try_parse_json(line))


def scan_jsonl(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """Strict reader: the job fails at the first line that is not JSON."""
    message = F.concat(F.lit("not JSON: line "), F.col("line_no").cast("string"))
    rows = parse_lines(scan_lines(spark, path, per_file))
    return rows.where(F.when(F.col("v").isNull(), F.raise_error(message)).otherwise(F.lit(True)))


def scan_jsonl_tolerant(spark: SparkSession, path: str, per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the unreadable lines beside them."""
    rows = parse_lines(scan_lines(spark, path, per_file))
    return rows.where(F.col("v").isNotNull()), rows.where(F.col("v").isNull()).drop("v")


def processed_ids(rows: DataFrame) -> DataFrame:
    """``nota_id`` of earlier outputs."""
    note_id = F.expr("try_variant_get(v, '$.nota.nota_id', 'string')").alias("nota_id")
    return rows.select(note_id).where("nota_id IS NOT NULL AND nota_id <> ''").distinct()


def last_per_key(rows: DataFrame, key: str, order: str, first: bool = False) -> DataFrame:
    """Last row per key, or the first. The group limit of the window drops earlier copies before the shuffle,
    so a key with very many copies never meets in one task."""
    newest = Window.partitionBy(key).orderBy(F.asc(order) if first else F.desc(order))
    return rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") == 1).drop("__r")


def manifest_rows(rows: DataFrame) -> DataFrame:
    """``custom_id, row_index, txt_file, fecha, texto`` of parsed manifest lines; last line wins."""
    at = lambda field, kind="string": F.expr(f"try_variant_get(v, '$.{field}', '{kind}')")
    fields = rows.select(
        at("custom_id").alias("custom_id"),
        F.coalesce(at("row_index", "bigint"), F.col("line_no") - 1).alias("row_index"),
        F.coalesce(at("txt_file"), at("custom_id")).alias("txt_file"),
        F.coalesce(at("fecha"), F.lit("S/D")).alias("fecha"),
        F.coalesce(at("texto"), F.lit("")).alias("texto"),
        "line_no",
    )
    return last_per_key(fields, "custom_id", "line_no").drop("line_no")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of one or many files; the last line of an id in path order wins."""
    return manifest_rows(scan_jsonl(spark, path, per_file=False))


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_rows(scan_jsonl(spark, path))


def gold_rows(rows: DataFrame) -> DataFrame:
    """Chat rows with ``gold``, the record parsed from the assistant turn."""
    content = F.expr(
        "try_variant_get(get(filter(try_variant_get(v, '$.messages', 'array<variant>'), "
        "m -> try_variant_get(m, '$.role', 'string') = 'assistant'), 0), '$.content', 'string')"
    )
    return once(rows, gold=F.try_parse_json(content))


def note_table(scan: DataFrame, id_col: str, date_col: str, text_col: str) -> DataFrame:
    """Trimmed ``txt_file, fecha, texto`` with the row index of the file."""
    cells = [normalize_cell(F.col(c)).alias(n) for c, n in ((id_col, "txt_file"), (date_col, "fecha"), (text_col, "texto"))]
    return scan.select("row_index", *cells)
