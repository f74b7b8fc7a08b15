"""Projection of full records onto the target schema, verdicts and the projection report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.text import event_bucket
from marginalia.functions.variants import projected, schema_valid
from marginalia.operators import contract
from marginalia.operators.rules import path_order, schema_findings
from marginalia.operators.walk import forbidden_paths, node_counts
from marginalia.session import materialize, once
from marginalia.schema import CORE_EVENT_FIELDS, TARGET, Node, ddl, walk_schema

#: Places that one message of a contract or of the forbidden keys names.
NAMED = 10
EVENT_POINTER = "/extraccion/eventos_protesta/*"
FALSE_EVENT_RULE = {EVENT_POINTER: (contract.EVENT_FLAG, CORE_EVENT_FIELDS)}


def project(df: DataFrame, source: str, node: Node = TARGET, out: str = "projected") -> DataFrame:
    """Adds the projected record as VARIANT, false events already blanked. Narrow."""
    return once(df, **{out: projected(source, node, FALSE_EVENT_RULE)})


def typed(value: str, node: Node = TARGET) -> Column:
    return F.expr(f"try_variant_get({value}, '$', '{ddl(node)}')")


def dropped_paths(df: DataFrame, source: str, node: Node = TARGET) -> DataFrame:
    """``path, dropped``: keys outside the schema below records of the schema.

    A dropped container counts once at its own path: what lies below it has a parent
    outside the schema, and is not walked. Counts are added up where the walk is done.
    """
    known = frozenset(p for p, _ in walk_schema(node))
    records = frozenset(p for p, n in walk_schema(node) if n.kind == "object")

    def choose(at: str, key: str | None, name: str) -> bool | None:
        if name in known:
            return False
        return True if key is not None and at in records else None

    keys = node_counts(df, source, choose)
    return keys.groupBy(F.col("pattern").alias("path")).agg(F.sum("n").alias("dropped"))


def top_dropped(df: DataFrame, source: str, node: Node = TARGET, n: int = 100) -> DataFrame:
    return dropped_paths(df, source, node).orderBy(F.desc("dropped"), "path").limit(n)


_TOTAL = "try_variant_get({v}, '$.extraccion.total_eventos_protesta', 'bigint')"
_HAS = "try_variant_get({v}, '$.extraccion.tiene_eventos_protesta', 'boolean')"


def row_invariants(value: str) -> Column:
    """Messages: the stated total is the list length, the flag says whether it is positive."""
    total, has = _TOTAL.format(v=value), _HAS.format(v=value)
    # counting the events needs none of them
    size = f"coalesce(size(try_variant_get({value}, '{contract.EVENTS_PATH}', 'array<boolean>')), 0)"
    return F.expr(
        "array_compact(array("
        f"CASE WHEN NOT ({total} <=> CAST({size} AS BIGINT)) THEN concat('total_eventos_protesta=', coalesce({total}, 'null'), "
        f"' but len(eventos_protesta)=', {size}) END, "
        f"CASE WHEN NOT ({has} <=> ({total} > 0)) THEN concat('tiene_eventos_protesta=', coalesce({has}, 'null'), "
        f"' inconsistent with total_eventos_protesta=', coalesce({total}, 'null')) END))"
    )


def judge(df: DataFrame, source: str, node: Node = TARGET) -> DataFrame:
    """Projects and decides validity inside the row.

    Adds ``projected``, ``source_violations``, ``projected_violations``, ``invariant_errors``,
    ``schema_ok`` and ``valid``. No shuffle: valid rows go straight to the sink.
    """
    checks = F.struct(
        contract.violation_count(source).alias("source_violations"),
        contract.violation_count("projected").alias("projected_violations"),
        row_invariants("projected").alias("invariant_errors"),
        schema_valid("projected", node).alias("schema_ok"),
    )
    return (
        once(project(df, source, node), __checks=checks)
        .select("*", "__checks.*")
        .drop("__checks")
        .withColumn(
            "valid",
            (F.col("source_violations") == 0) & (F.col("projected_violations") == 0)
            & (F.size("invariant_errors") == 0) & F.col("schema_ok"),
        )
    )


def row_errors(judged: DataFrame, source: str, key: str, node: Node = TARGET, shown: int = 20) -> DataFrame:
    """``key, rank, error`` of invalid rows, at most ``shown`` each, in report order.

    Order: source contract, projected contract, invariants, forbidden keys, schema. Either
    contract and the forbidden keys give one message, which names the first ``NAMED``
    places; schema messages come by path, list positions as numbers. Only invalid rows are
    walked and only their messages are shuffled.
    """
    # five branches read the invalid rows, so they are computed once and kept, records only where they are walked
    bad = materialize(judged.where(~F.col("valid")).select(
        key, "schema_ok", "invariant_errors", contract.violation_places(source).alias("source_places"),
        contract.violation_places("projected").alias("projected_places"), F.when(~F.col("schema_ok"), F.col("projected")).alias("projected")))

    def block(rows: DataFrame, number: int, place: Column, error: Column) -> DataFrame:
        return rows.select(key, F.lit(number).alias("block"), place.alias("place"), error.alias("error"))

    def listed(label: str, places: Column) -> Column:
        return F.concat(F.lit(label + ": "), F.array_join(F.slice(places, 1, NAMED), ", "))

    def contract_rows(places: str, number: int, label: str) -> DataFrame:
        return block(bad.where(F.size(places) > 0), number, F.array(F.lit("")), listed(label, F.col(places)))

    messages = bad.select(key, F.posexplode("invariant_errors").alias("at", "error"))
    loose = bad.where(~F.col("schema_ok"))
    survived = forbidden_paths(loose, "projected", [key])
    by_pointer = Window.partitionBy(key).orderBy(path_order("pointer"))
    survived = survived.withColumn("at", F.row_number().over(by_pointer)).where(F.col("at") <= NAMED)
    survived = survived.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "pointer"))).alias("found"))
    findings = schema_findings(loose, "projected", node, [key])
    everything = (
        contract_rows("source_places", 1, "source detail must be null")
        .unionByName(contract_rows("projected_places", 2, "projected detail must be null"))
        .unionByName(block(messages, 3, F.array(F.col("at").cast("string")), F.col("error")))
        .unionByName(block(survived, 4, F.array(F.lit("")), listed("forbidden paths survived", F.col("found.pointer"))))
        .unionByName(block(findings, 5, path_order("path"), F.concat("path", F.lit(": "), "message")))
    )
    order = Window.partitionBy(key).orderBy("block", "place", "error")
    return everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select(key, "rank", "error")


def projection_report(judged: DataFrame) -> DataFrame:
    """One row: totals and the contract block."""
    return judged.agg(
        F.count("*").alias("processed"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("source_violations") > 0).alias("source_rows_with_non_null_details"),
        F.count_if(F.col("projected_violations") > 0).alias("projected_rows_with_non_null_details"),
    ).withColumn("all_valid", (F.col("processed") == F.col("valid")) & (F.col("processed") > 0)).withColumn(
        "contract_pass",
        (F.col("source_rows_with_non_null_details") == 0) & (F.col("projected_rows_with_non_null_details") == 0),
    )


def valid_distributions(judged: DataFrame) -> DataFrame:
    """``dist, value, n`` of has-events and event bucket over valid rows, in one pass."""
    has = F.expr(_HAS.format(v="projected")).cast("string").alias("has")
    bucket = event_bucket(F.expr(_TOTAL.format(v="projected"))).alias("bucket")
    cells = judged.where("valid").select(has, bucket).groupBy("has", "bucket").agg(F.count("*").alias("n"))
    return cells.select(
        F.explode(F.array(
            F.struct(F.lit("tiene_eventos_protesta").alias("dist"), F.col("has").alias("value")),
            F.struct(F.lit("total_eventos_protesta_bucket").alias("dist"), F.col("bucket").alias("value")),
        )).alias("d"), "n",
    ).groupBy("d.dist", "d.value").agg(F.sum("n").alias("n"))
