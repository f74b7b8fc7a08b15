"""The null contract: an event flagged false carries only its core fields.

Every other field must be null as a whole: an empty list, an empty record or a record of
nulls breaks the contract. A flag that is null or missing is not false.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.sqltext import quote
from marginalia.functions.variants import entries
from marginalia.operators.walk import is_leaf, walk
from marginalia.schema import CORE_EVENT_FIELDS, SD, Node

EVENT_FLAG = "es_evento_protesta"
EVENTS_PATH = "$.extraccion.eventos_protesta"


def events_sql(v: str) -> str:
    return f"try_variant_get({v}, '{EVENTS_PATH}', 'array<variant>')"


def is_false_event(e: str) -> str:
    flag = f"try_variant_get({e}, '$.{EVENT_FLAG}', 'variant')"
    return f"coalesce(schema_of_variant({flag}) = 'BOOLEAN' AND NOT try_variant_get({flag}, '$', 'boolean'), false)"


def _broken_fields(e: str, core: Sequence[str]) -> str:
    kept = ", ".join(quote(c) for c in core)
    return f"filter(map_entries({entries(e)}), f -> f.key NOT IN ({kept}) AND NOT is_variant_null(f.value))"


def violation_count(value: str, core: Sequence[str] = CORE_EVENT_FIELDS) -> Column:
    """Broken fields of a note, counted inside the row."""
    return F.expr(
        f"coalesce(aggregate({events_sql(value)}, 0, (acc, e) -> acc + "
        f"CASE WHEN {is_false_event('e')} THEN size({_broken_fields('e', core)}) ELSE 0 END), 0)"
    )


def violation_places(value: str, core: Sequence[str] = CORE_EVENT_FIELDS) -> Column:
    """Places of the broken fields of a note, by event and key, listed inside the row."""
    key = "replace(replace(f.key, '~', '~0'), '/', '~1')"
    named = f"transform({_broken_fields('e', core)}, f -> concat('eventos_protesta[', i, ']/', {key}))"
    return F.expr(
        f"flatten(transform({events_sql(value)}, (e, i) -> CASE WHEN {is_false_event('e')} THEN {named} "
        "ELSE CAST(array() AS ARRAY<STRING>) END))"
    )


def false_event_violations(
    df: DataFrame, value: str, keep: Sequence[str], core: Sequence[str] = CORE_EVENT_FIELDS
) -> DataFrame:
    """One row per broken field: ``keep, event_index, field, pointer, v``. Narrow."""
    events = df.select(*keep, F.posexplode(F.expr(events_sql(value))).alias("event_index", "e"))
    broken = events.where(F.expr(is_false_event("e"))).select(
        *keep, "event_index", F.explode(F.expr(_broken_fields("e", core))).alias("f")
    )
    pointer = F.concat(F.lit("/"), F.replace(F.replace("f.key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    return broken.select(*keep, "event_index", F.col("f.key").alias("field"), pointer.alias("pointer"), F.col("f.value").alias("v"))


def violation_context(violations: DataFrame, keep: Sequence[str], shown: int = 5) -> DataFrame:
    """Violations with the first non-null leaf pointers below each.

    Only the leaves of broken fields are walked. The ranked window keeps ``shown`` leaves
    per field before the shuffle, so a large field is never gathered.
    """
    key = [*keep, "event_index", "field"]
    leaves = walk(violations.withColumnRenamed("pointer", "at"), "v", [*key, "at"], ("pointer",)).where(is_leaf() & (F.col("type") != "null"))
    order = Window.partitionBy(*key).orderBy("leaf")
    first = (
        leaves.select(*key, F.concat("at", "pointer").alias("leaf"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= shown)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    )
    return violations.drop("v").join(first, key, "left")


def false_event_leaves(df: DataFrame, value: str, keep: Sequence[str]) -> DataFrame:
    """The strict variant: every non-null leaf of a false event except the flag, ids included."""
    events = df.select(*keep, F.posexplode(F.expr(events_sql(value))).alias("event_index", "e"))
    leaves = walk(events.where(F.expr(is_false_event("e"))), "e", [*keep, "event_index"], ("path",))
    broken = is_leaf() & (F.col("path") != EVENT_FLAG) & (F.col("type") != "null")
    return leaves.where(broken).select(*keep, "event_index", "path", "value")


def false_event_leaf_check(df: DataFrame, value: str) -> DataFrame:
    """One row: ``violation_count, sd_violation_count, status``."""
    found = false_event_leaves(df, value, [])
    return found.agg(
        F.count("*").alias("violation_count"), F.count_if(F.col("value") == SD).alias("sd_violation_count")
    ).withColumn("status", F.when(F.col("violation_count") == 0, "pass").otherwise("fail"))


def _payloads() -> Column:
    """The records of a parsed JSON line (column ``v``) with their places in it."""
    is_chat = F.expr("try_variant_get(v, '$.extraccion', 'variant') IS NULL AND try_variant_get(v, '$.messages', 'array<variant>') IS NOT NULL")
    message = F.expr(
        "transform(try_variant_get(v, '$.messages', 'array<variant>'), (m, i) -> named_struct("
        "'source', concat('messages[', i, '].content'), 'payload', CASE WHEN try_variant_get(m, '$.role', 'string') = 'assistant' "
        "AND schema_of_variant(try_variant_get(m, '$.content', 'variant')) = 'STRING' "
        "THEN try_parse_json(try_variant_get(m, '$.content', 'string')) END))"
    )
    whole = F.expr("array(named_struct('source', 'row', 'payload', v))")
    return F.when(is_chat, message).otherwise(whole)


def validation_payloads(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Records to check in parsed JSON lines (column ``v``): the row itself, or for a chat
    row every assistant message that parses to an object."""
    return lines.select(*keep, F.explode(_payloads()).alias("p")).select(*keep, "p.source", "p.payload")


def null_contract_files(lines: DataFrame, file: str = "file") -> DataFrame:
    """Per input file: ``rows, violating, status``. One pass over the lines; counts combine map-side."""
    payloads = lines.select(file, F.posexplode_outer(_payloads()).alias("at", "p"))
    # a chat row without messages holds no payload and counts as a row all the same
    first, broken = F.coalesce(F.col("at"), F.lit(0)) == 0, F.col(file).isNotNull() & (violation_count("p.payload") > 0)
    counts = payloads.groupBy(file).agg(F.count_if(first).alias("rows"), F.count_if(broken).alias("violating"))
    return counts.withColumn("status", F.when(F.col("violating") == 0, "PASS").otherwise("FAIL"))


def contract_holds(per_file: DataFrame) -> DataFrame:
    """One row ``pass``: at least one input row and no violation in any file."""
    return per_file.agg(
        (F.coalesce(F.sum("rows"), F.lit(0)) > 0).alias("any"), (F.coalesce(F.sum("violating"), F.lit(0)) == 0).alias("clean")
    ).select((F.col("any") & F.col("clean")).alias("pass"))


def nullify_false_events(record: str, node: Node, core: Sequence[str] = CORE_EVENT_FIELDS) -> Column:
    """A typed note whose false events keep only their core fields."""
    from marginalia.schema import ddl

    events = node.props["extraccion"].props["eventos_protesta"]
    fields = ", ".join(
        f"{quote(k)}, " + (f"e.{k}" if k in core else f"CAST(NULL AS {ddl(c)})") for k, c in events.item.props.items()
    )
    blanked = (
        f"transform({record}.extraccion.eventos_protesta, e -> CASE WHEN e.{EVENT_FLAG} <=> false "
        f"THEN named_struct({fields}) ELSE e END)"
    )
    return F.col(record).withField("extraccion.eventos_protesta", F.expr(blanked))
