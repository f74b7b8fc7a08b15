"""Row selection and row contracts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.text import normalize_cell
from marginalia.session import broadcast_if_small, materialize

SHORT_LIST = 1000
#: Rows that one task may sort for a top-k.
TOP = 10_000


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same DataFrame, or an error naming missing and available columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def nth_key(df: DataFrame, order: str, n: int) -> tuple[object, int] | None:
    """The ``n``-th smallest value of ``order`` and how many of the values equal to it are among the first ``n``.

    None if there are fewer than ``n`` rows. For a small ``n`` this is a top-k. Beyond, the keys
    alone are sorted into ranges; counts per range tell which one holds the place, and only
    that range is ranked, so no task holds ``n`` keys. Null keys come first, as they sort.
    """
    keys = df.select(F.col(order).alias("k"))
    if n <= TOP:
        found = keys.orderBy("k").limit(n).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
        return (found[0].k, found[0].n) if sum(r.n for r in found) == n else None
    ranges = materialize(keys.groupBy("k").agg(F.count("*").alias("n")).repartitionByRange("k").sortWithinPartitions("k")
                         .withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r.n) for r in ranges.groupBy("range").agg(F.sum("n").alias("n")).collect())  # one row per range
    before = 0
    for part, size in sizes:
        if before + size >= n:
            break
        before += size
    else:
        return None
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("k"))
    held = ranges.where(F.col("range") == part).withColumn("upto", upto + before)
    row = held.where((F.col("upto") >= n) & (F.col("upto") - F.col("n") < n)).first()
    return row.k, n - (row.upto - row.n)


def slice_offset(df: DataFrame, order: str, start: int, dense: bool = False) -> DataFrame:
    """Rows after the first ``start`` in ``order``.

    Where ``order`` is a dense row index (as the readers number rows) this is a plain
    filter. Any other key must be unique; its ``start``-th value is found and the table itself
    is neither sorted nor gathered.
    """
    if start <= 0:
        return df
    if dense:
        return df.where(F.col(order) >= start)
    found = nth_key(df, order, start)
    return df.limit(0) if found is None else df.where(F.col(order) > F.lit(found[0]).cast(df.schema[order].dataType))


def limit_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows in ``order``, as a set; of rows that share the last key as many as fit."""
    if n <= TOP:
        return df.orderBy(order).limit(n)
    found = nth_key(df, order, n)
    if found is None:
        return df
    key, fitting = F.lit(found[0]).cast(df.schema[order].dataType), found[1]
    last = df.where(F.col(order).eqNullSafe(key))
    below = df.where(F.col(order).isNull() if found[0] is None else F.col(order).isNull() | (F.col(order) < key))
    return (df.limit(0) if found[0] is None else below).unionByName(last.limit(fitting))


def filter_ids(df: DataFrame, key: str, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose key is in a short list, or in the first column of a table of any size."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("__id"))
        return df.join(wanted, F.col(key).cast("string") == F.col("__id"), "left_semi")
    if len(ids) > SHORT_LIST:
        return filter_ids(df, key, df.sparkSession.createDataFrame([(str(i),) for i in ids], "id string"))
    return df.where(F.col(key).cast("string").isin([str(i) for i in ids]))


def skip_processed(df: DataFrame, key: str, done: DataFrame, done_key: str) -> DataFrame:
    """Rows without earlier output. The processed ids are made distinct before the join."""
    ids = done.select(F.col(done_key).cast("string").alias("__id")).where("__id IS NOT NULL AND __id <> ''").distinct()
    return df.join(ids, F.col(key).cast("string") == F.col("__id"), "left_anti")


def select_rows(
    df: DataFrame, key: str, order: str, start: int = 0, ids: Sequence[str] | DataFrame | None = None,
    done: DataFrame | None = None, done_key: str = "nota_id", limit: int | None = None, dense: bool = False,
) -> DataFrame:
    """Offset, id list, resume filter and limit, in this order; ``dense`` tells that ``order`` is a dense row index."""
    df = slice_offset(df, order, start, dense)
    if ids is not None:
        df = filter_ids(df, key, ids)
    if done is not None:
        df = skip_processed(df, key, done, done_key)
    return df if limit is None else limit_rows(df, order, limit)


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of all keys that occur more than once (map-side partial counts)."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_ids(df: DataFrame, key: str, shown: int = 10) -> DataFrame:
    return duplicated(df, key).orderBy(key).limit(shown)


def row_contract(df: DataFrame, id_col: str, date_col: str, text_col: str) -> DataFrame:
    """Normalised cells plus ``errors``: empty id, duplicate id, empty date, empty text.

    Copies are counted on the id alone and joined back, so a hot id is pre-aggregated and
    never meets its texts in one task: duplicated ids are few and the join side is small.
    """
    cells = df.withColumns({c: normalize_cell(F.col(c)) for c in (id_col, date_col, text_col)})
    copies = duplicated(cells.where(F.col(id_col) != ""), id_col).withColumnRenamed(id_col, "__id")
    checked = cells.join(copies, F.col(id_col) == F.col("__id"), "left")
    return checked.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(F.col(id_col) == "", F.lit("empty id")),
                F.when(F.col("copies").isNotNull(), F.lit("duplicate id")),
                F.when(F.col(date_col) == "", F.lit("empty date")),
                F.when(F.col(text_col) == "", F.lit("empty text")),
            )
        ),
    ).drop("__id", "copies")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("errors") == 0)


def enforce(df: DataFrame) -> DataFrame:
    """Fail the job at the first row that breaks its contract."""
    message = F.concat(F.lit("row contract broken: "), F.array_join("errors", ", "))
    guard = F.when(F.size("errors") > 0, F.raise_error(message)).otherwise(F.lit(True))
    return df.where(guard)


def over_limit(df: DataFrame, tokens: str, limit: int, prompt: Column | None = None) -> DataFrame:
    """Rows strictly above the limit, their excess and the head of the last prompt turn."""
    rows = df.where(F.col(tokens) > limit).withColumn("excess", F.col(tokens) - limit)
    return rows if prompt is None else rows.withColumn("prompt_first_chars", F.substring(prompt, 1, 120))


def enum_match(df: DataFrame, value: str, members: DataFrame, member: str, order: str | None = None) -> DataFrame:
    """Left join of a text to the member it equals up to case, accents and spaces.

    The collated key makes this an equi join. Of several members with one key the first in
    ``order``, else in text order, counts, so no row is doubled. The member list is broadcast
    only while its size is checked; a larger one is joined by shuffle.
    """
    from marginalia.functions.text import norm_match

    keyed = members.groupBy(norm_match(F.col(member)).alias("__k")).agg(
        F.min_by(F.col(member), F.struct(order or member, member)).alias("matched"))
    return df.withColumn("__v", norm_match(F.col(value))).join(
        broadcast_if_small(keyed, SHORT_LIST), F.col("__v") == F.col("__k"), "left"
    ).drop("__v", "__k")
