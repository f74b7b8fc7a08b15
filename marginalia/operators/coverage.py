"""Swaps that bring every frequent category into the eval part.

Each swap depends on the ones before it, so they are replayed one after the other. The replay
needs few rows, and these are found on Spark in one pass each. With M categories to bring in,
at most M swaps happen. So for each of them the first M + 1 train rows that hold it are enough.
Among the eval rows of a stratum, those up to its M + 1st safe row are enough: a row is safe if
its categories are so frequent in eval that M swaps cannot make one of them rare. Rows with a
category that is rare in eval come on top; a rare category has few rows by definition.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.operators.split import MAX_CUTS, NO_EVENTS, order_hash
from marginalia.session import broadcast_if_small, materialize

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CATEGORY_COUNT = 3


class Candidates:
    """Rows by category and, of the eval part, by stratum in order of place. A swap gives each row the other's place."""

    def __init__(self, rows: list[dict]) -> None:
        self.by_category: dict[str, list[dict]] = {}
        self.eval_of: dict[str, list[dict]] = {}
        for row in sorted(rows, key=lambda r: (r["stratum"], r["hash"], r["id"])):
            row["place"] = (row["stratum"], row["hash"], row["id"])
            for category in set(row["cats"]):
                self.by_category.setdefault(category, []).append(row)
            if row["split"] == "eval":
                self.eval_of.setdefault(row["stratum"], []).append(row)

    def donor(self, category: str) -> dict | None:
        return min((r for r in self.by_category.get(category, []) if r["split"] == "train"), key=lambda r: r["place"], default=None)

    def receiver(self, stratum: str, in_eval: Counter) -> int | None:
        """Place in the stratum's list of the first row all of whose categories occur more than once."""
        for at, row in enumerate(self.eval_of.get(stratum, [])):
            if all(c == NO_EVENTS or in_eval[c] > 1 for c in row["cats"]):
                return at
        return None

    def swap(self, donor: dict, at: int) -> dict:
        here = self.eval_of[donor["stratum"]]
        receiver, here[at] = here[at], donor
        donor["split"], receiver["split"] = "eval", "train"
        donor["place"], receiver["place"] = receiver["place"], donor["place"]
        return receiver


def replay(categories: list[str], rows: list[dict], in_eval: Counter, frequent: set[str]) -> tuple[list[tuple], str | None]:
    """Swaps ``(number, category, donor, receiver, stratum)`` in order of category, and a frequent category outside
    ``categories`` that lost its last eval row before its turn, if there is one."""
    table, swaps = Candidates(rows), []
    for category in categories:
        donor = None if in_eval[category] > 0 else table.donor(category)
        at = None if donor is None else table.receiver(donor["stratum"], in_eval)
        if at is None:
            continue
        receiver = table.swap(donor, at)
        in_eval.update(donor["cats"])
        in_eval.subtract(receiver["cats"])
        swaps.append((len(swaps) + 1, category, donor["id"], receiver["id"], donor["stratum"]))
        lost = [c for c in frequent.intersection(receiver["cats"]).difference(categories) if in_eval[c] == 0 and c > category]
        if lost:
            return swaps, min(lost)
    return swaps, None


def _replayed(spec: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [fields for batch in batches for fields in batch.to_pylist()]
        rows = [f for f in found if f["category"] is None]
        counted = [f for f in found if f["category"] is not None]
        categories = sorted(f["category"] for f in counted if f["bring_in"])
        frequent = {f["category"] for f in counted if f["frequent"]}
        swaps, lost = replay(categories, rows, Counter({f["category"]: f["n_eval"] for f in counted}), frequent)
        if lost is not None:
            swaps.append((0, lost, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in swaps], field.type) for k, field in enumerate(spec)], schema=spec)

    return run


def _candidates(slim: DataFrame, counts: DataFrame, wanted: DataFrame, m: int) -> DataFrame:
    """Rows and counts that the replay of ``m`` categories needs."""
    order = ("stratum", "hash", "id")
    held = slim.select(*order, "split", F.explode(F.array_distinct("cats")).alias("category"))
    ranked = held.where("split = 'train'").join(wanted.select("category"), "category", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    donors = materialize(ranked.where(F.col("rank") <= m + 1).select("id", "stratum").distinct())

    eval_rows = slim.where("split = 'eval'").join(donors.select("stratum").distinct(), "stratum", "left_semi")
    longest = slim.where("split = 'eval'").agg(F.max(F.size("cats"))).first()[0] or 0
    rare = counts.where((F.col("category") != NO_EVENTS) & (F.col("n_eval") <= 1 + m * longest)).select("category")
    unsafe = held.where("split = 'eval'").join(rare, "category", "left_semi").select("id").distinct()
    safe = eval_rows.join(unsafe, "id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("hash", "id")))
    ends = materialize(safe.where(F.col("rank") <= m + 1).groupBy("stratum").agg(
        F.count("*").alias("n"), F.max(F.struct("hash", "id")).alias("end")).where(F.col("n") > m).drop("n"))
    receivers = eval_rows.join(broadcast_if_small(ends, MAX_CUTS), "stratum", "left").where(
        F.col("end").isNull() | (F.struct("hash", "id") <= F.col("end"))).select("id")

    rows = slim.join(materialize(donors.select("id").union(receivers).distinct()), "id", "left_semi")
    present = rows.select(F.explode("cats").alias("category")).union(wanted.select("category")).distinct()
    counted = counts.join(present, "category").join(wanted.select("category", F.lit(True).alias("bring_in")), "category", "left")
    return rows.select(*order, "cats", "split").unionByName(counted.select(
        "category", "n_eval", F.coalesce("bring_in", F.lit(False)).alias("bring_in"), "frequent"), allowMissingColumns=True)


def cover_categories(
    rows: DataFrame, key: str, categories: str, seed: int, minimum: int = MIN_CATEGORY_COUNT
) -> tuple[DataFrame, DataFrame]:
    """Swaps rows of one stratum so that every category of at least ``minimum`` occurrences has one in eval.

    Returns the rows with the new ``split``, and the swaps ``(number, category, train_to_eval,
    eval_to_train, stratum)``. Categories go in sorted order. The row that comes in is the first
    train row with the category, by stratum and salted digest of the key; the row that leaves is
    the first eval row of its stratum all of whose categories occur in eval more than once. Each
    takes the other's place. Where no row may leave, the category stays out. ``categories`` is a
    list and may repeat a category; each occurrence counts.

    A category that was in eval can lose its last row to a swap before its turn. The replay
    reports that, and is done again with this category among those to bring in; so there are as
    many replays as such categories, and one if there is none.
    """
    slim = materialize(rows.select(
        F.col(key).alias("id"), "stratum", order_hash(F.col(key), seed).alias("hash"), F.col(categories).alias("cats"), "split"))
    counts = materialize(slim.select("split", F.explode("cats").alias("category")).where(F.col("category").isNotNull()).groupBy("category").agg(
        ((F.count("*") >= minimum) & (F.first("category") != NO_EVENTS)).alias("frequent"), F.count_if(F.col("split") == "eval").alias("n_eval")))
    id_type = slim.schema["id"].dataType
    spec = T.StructType([
        T.StructField("number", T.LongType()), T.StructField("category", T.StringType()), T.StructField("train_to_eval", id_type),
        T.StructField("eval_to_train", id_type), T.StructField("stratum", T.StringType())])
    lost: list[str] = []
    while True:
        wanted = materialize(counts.where(F.col("frequent") & ((F.col("n_eval") == 0) | F.col("category").isin(lost))))
        table = _candidates(slim, counts, wanted, wanted.count())
        swaps = materialize(table.repartition(1).mapInArrow(_replayed(to_arrow_schema(spec)), spec))
        again = swaps.where("number = 0").first()
        if again is None:
            break
        lost.append(again.category)
    moved = swaps.select(F.col("number"), F.explode(F.array(
        F.struct(F.col("train_to_eval").alias("__id"), F.lit("eval").alias("__to")),
        F.struct(F.col("eval_to_train").alias("__id"), F.lit("train").alias("__to")))).alias("m"))
    last = moved.groupBy("m.__id").agg(F.max_by("m.__to", "number").alias("__to"))
    out = rows.join(broadcast_if_small(last, MAX_CUTS), F.col(key) == F.col("__id"), "left")
    return out.withColumn("split", F.coalesce("__to", "split")).drop("__id", "__to"), swaps
