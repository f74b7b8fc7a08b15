"""Distributions and length statistics from pre-aggregated value counts.

Every statistic starts from ``groupBy(group, value).count()``: tasks combine equal values
first, so a group holding a third of all rows reaches the shuffle as one row per distinct
value. Exact order statistics are then read off cumulative counts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def _cumulated(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    counts = value_counts(df, by, value)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns(
        {"total": F.sum("n").over(whole), "upto": F.sum("n").over(running),
         "mean": F.sum(F.col("n") * F.col(value)).over(whole) / F.sum("n").over(whole)}
    )


def _at(value: str, index: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted group."""
    here = (F.col("upto") - F.col("n") <= index) & (index < F.col("upto"))
    return F.max(F.when(here, F.col(value)))


def _position(q: float) -> Column:
    return F.lit(q) * (F.col("total") - 1)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def len_stats_floor(df: DataFrame, by: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    """``min, max, p95`` with the quantile at the floor index."""
    return _cumulated(df, by, value).groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), _at(value, _whole(_position(q))).alias("p95")
    )


def len_stats_upper(df: DataFrame, by: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    """``examples, min, max, mean, p95`` with the quantile at the next index, except at the end."""
    index = F.least(_whole(_position(q)) + 1, F.col("total") - 1)
    return _cumulated(df, by, value).groupBy(*by).agg(
        F.sum("n").alias("examples"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.bround(F.max("mean"), 2).alias("mean"), _at(value, index).alias("p95"),
    )


def len_stats_linear(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Full audit block: mean, median, deviation and interpolated percentiles."""
    quantiles = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    parts, final = [], {}
    for name, q in quantiles.items():
        low = _whole(_position(q))
        parts += [
            _at(value, low).alias(f"{name}_low"),
            _at(value, F.least(low + 1, F.col("total") - 1)).alias(f"{name}_high"),
            F.max(_position(q) - low).alias(f"{name}_frac"),
        ]
        lower, upper, frac = F.col(f"{name}_low"), F.col(f"{name}_high"), F.col(f"{name}_frac")
        final[name] = F.bround(lower * (1 - frac) + upper * frac).cast("long")
    spread = F.sum(F.col("n") * F.pow(F.col(value) - F.col("mean"), 2)) / F.max("total")
    grouped = _cumulated(df, by, value).groupBy(*by).agg(
        F.sum("n").alias("examples"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.bround(F.max("mean"), 2).alias("mean"), F.bround(F.sqrt(spread), 2).alias("stdev"),
        _at(value, _whole((F.col("total") - 1) / 2)).alias("mid_low"), _at(value, _whole(F.col("total") / 2)).alias("mid_high"),
        *parts,
    )
    median = ((F.col("mid_low") + F.col("mid_high")) / 2).cast("long")
    return grouped.withColumns({"median": median, **final}).select(
        *by, "examples", "min", "max", "mean", "median", "stdev", *quantiles
    )


def distribution(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(F.col(column).alias(name or column)).agg(F.count("*").alias("n"))


def by_split(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """``dist, value, part, n`` of several columns, per split and for all, in one pass. Of a list every item counts."""

    def values(name: str) -> Column:
        listed = F.col(name) if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(name)
        return F.transform(listed, lambda v: F.struct(F.lit(name).alias("dist"), v.cast("string").alias("value")))

    long = df.select(split, F.explode(F.concat(*[values(c) for c in columns])).alias("d")).groupBy("d.dist", "d.value", split).agg(F.count("*").alias("n"))
    whole = long.groupBy("dist", "value").agg(F.sum("n").alias("n")).withColumn(split, F.lit("all"))
    return long.unionByName(whole).withColumnRenamed(split, "part")


def longest_rows(df: DataFrame, tokens: str, order: str, n: int = 5) -> DataFrame:
    """Longest rows, in input order among equals."""
    return df.orderBy(F.desc(tokens), F.asc(order)).limit(n)
