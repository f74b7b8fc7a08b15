"""Stratified train/eval split with exact sizes and category coverage.

Rows are ordered inside a stratum by a salted md5 of their id, which replaces a seeded
shuffle: the same seed gives the same split whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.session import broadcast_if_small, materialize

NO_EVENTS = "<sin_eventos>"
MAX_CUTS = 100_000
#: Rows of one hash bucket, about: a stratum's buckets follow from its size.
BUCKET_ROWS = 20_000


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def strata_sizes(df: DataFrame, stratum: str = "stratum") -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("size"))


def allocate(strata: DataFrame, ratio: float | None = None, eval_size: int | None = None) -> DataFrame:
    """``stratum, size, n_eval``; fails the job if the size cannot be met.

    Proportional shares rounded down, at least one where a stratum has more than one row,
    never a whole stratum; missing rows go to the largest fractions, surplus rows leave the
    smallest. The table has one row per stratum, so its windows are tiny.
    """
    everything = Window.partitionBy(F.lit(0))
    target = F.lit(eval_size) if eval_size is not None else F.bround(F.col("total") * ratio).cast("long")
    shares = (
        strata.withColumn("total", F.sum("size").over(everything))
        .withColumn("target", target)
        .withColumn("exact", F.col("size") * F.col("target") / F.col("total"))
        .withColumn("fraction", F.col("exact") - F.floor("exact"))
    )
    least_one = F.greatest(F.floor("exact"), F.lit(1))
    base = F.when(F.col("size") > 1, F.least(least_one, F.col("size") - 1)).otherwise(F.lit(0))
    based = shares.withColumn("base", base).withColumn("missing", F.col("target") - F.sum("base").over(everything))
    rank_up = F.row_number().over(everything.orderBy(F.desc("fraction"), F.desc("stratum")))
    raised = based.withColumn("n1", F.col("base") + (rank_up <= F.col("missing")).cast("long"))
    loose = (F.col("n1") > 0) & (F.col("size") > F.col("n1"))
    rank_down = F.row_number().over(Window.partitionBy("loose").orderBy("fraction", "stratum"))
    lowered = (
        raised.withColumn("surplus", F.sum("n1").over(everything) - F.col("target"))
        .withColumn("loose", loose)
        .withColumn("n_eval", F.col("n1") - (F.col("loose") & (rank_down <= F.col("surplus"))).cast("long"))
    )
    met = F.sum("n_eval").over(everything) == F.col("target")
    checked = F.when(met, F.col("n_eval")).otherwise(F.raise_error(F.lit("cannot allocate the requested eval size")).cast("long"))
    return lowered.select("stratum", "size", checked.cast("long").alias("n_eval"))


def bucket_digits(largest: int) -> int:
    """Hex digits of the digest that cut a stratum of ``largest`` rows into buckets of at most some ``BUCKET_ROWS`` rows."""
    digits = 0
    while largest > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def cuts(rows: DataFrame, allocation: DataFrame, key: str, seed: int) -> DataFrame:
    """``stratum, cut_hash, cut_key``: the last eval row of every stratum that has one.

    Rows are counted per stratum and digest prefix, long enough for even buckets of bounded
    size. The counts tell which one bucket holds the cut, and only its rows are ranked.
    """
    digits = bucket_digits(allocation.agg(F.max("size")).first()[0] or 0)
    bucket = F.substring(order_hash(F.col(key), seed), 1, digits).alias("bucket")
    counts = materialize(rows.select("stratum", bucket).groupBy("stratum", "bucket").agg(F.count("*").alias("n")))
    running = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    holding = counts.withColumn("upto", F.sum("n").over(running)).join(allocation.select("stratum", "n_eval"), "stratum").where(
        (F.col("n_eval") > F.col("upto") - F.col("n")) & (F.col("n_eval") <= F.col("upto"))
    ).select("stratum", "bucket", (F.col("n_eval") - (F.col("upto") - F.col("n"))).alias("place"))
    hashed = rows.select(F.col(key).alias("k"), "stratum", order_hash(F.col(key), seed).alias("h"))
    near = hashed.withColumn("bucket", F.substring("h", 1, digits)).join(
        broadcast_if_small(materialize(holding), MAX_CUTS), ["stratum", "bucket"]
    )
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "k")))
    return ranked.where(F.col("r") == F.col("place")).select("stratum", F.col("h").alias("cut_hash"), F.col("k").alias("cut_key"))


def stratified(
    rows: DataFrame, key: str, seed: int, ratio: float | None = None, eval_size: int | None = None
) -> DataFrame:
    """Adds ``split`` with exact sizes per stratum.

    Three passes over the two key columns find each stratum's size and cut; then every row is
    compared with the cut of its stratum. The payload is never shuffled, and the small tables
    between the passes (one row per stratum, or per stratum and bucket) are kept.
    """
    allocation = materialize(allocate(strata_sizes(rows), ratio, eval_size))
    found = materialize(cuts(rows, allocation, key, seed))
    h = order_hash(F.col(key), seed)
    inside = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col(key) <= F.col("cut_key")))
    return rows.join(broadcast_if_small(found, MAX_CUTS), "stratum", "left").withColumn(
        "split", F.when(F.coalesce(inside, F.lit(False)), "eval").otherwise("train")
    ).drop("cut_hash", "cut_key")


def split_sorted(rows: DataFrame, key: str) -> DataFrame:
    """Both parts sorted by id: a range-partitioned sort."""
    return rows.orderBy("split", key)


def set_checks(rows: DataFrame, all_rows: DataFrame, key: str) -> DataFrame:
    """One row: sizes add up, and no id is in both parts."""
    sides = rows.groupBy(key).agg(F.count_distinct("split").alias("sides"), F.count("*").alias("n"))
    got = sides.agg(F.sum("n").alias("split_rows"), F.count_if(F.col("sides") > 1).alias("overlap"))
    return got.withColumn("all_rows", all_rows.agg(F.count("*")).scalar()).withColumn(
        "ok", (F.col("overlap") == 0) & (F.col("split_rows") == F.col("all_rows"))
    )


def event_categories(record: str) -> Column:
    """Primary action categories of a typed note; events without an action are skipped."""
    return F.expr(
        f"CASE WHEN exists({record}.extraccion.eventos_protesta, e -> e.accion.formato_principal IS NOT NULL) THEN "
        f"transform(filter({record}.extraccion.eventos_protesta, e -> e.accion.formato_principal IS NOT NULL), "
        "e -> coalesce(nullif(e.accion.formato_principal.categoria, ''), 'S/D')) "
        f"ELSE array('{NO_EVENTS}') END"
    )
