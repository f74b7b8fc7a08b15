"""Chat rows: building, contracts, audits and token gates."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from marginalia.functions.text import MAX_SEQ_LENGTH, header_count, token_proxy
from marginalia.functions.variants import schema_valid
from marginalia.operators import contract
from marginalia.operators.rules import path_order, validity_detail
from marginalia.operators.walk import forbidden_paths, has_forbidden
from marginalia.schema import TARGET, Node
from marginalia.session import once

ROLES = ("system", "user", "assistant")
SHOWN_MESSAGES, SHOWN_PATHS = 10, 20
CRITICAL = (
    "missing_user_messages", "duplicate_user_message_risks", "assistant_schema_invalid",
    "assistant_forbidden_paths", "assistant_false_event_detail_violations",
)


def latest_text(texts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One text per id, the last one; copies combine before the shuffle."""
    return texts.groupBy(key).agg(F.max_by(text, order).alias(text))


def join_user_text(rows: DataFrame, texts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Rows with their original text, null where there is none."""
    return rows.join(latest_text(texts, key, text, order), key, "left")


def missing_user_text(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    return rows.join(texts.select(key).distinct(), key, "left_anti")


def messages_array(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in zip(ROLES, (system, user, assistant))]
    )


def record_json(record: Column) -> Column:
    """Compact JSON of a typed record with its nulls."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def messages_tokens(messages: str) -> Column:
    """Token proxy summed over the messages of a row."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda acc, m: acc + token_proxy(m["content"]))


# --- contracts over untyped rows ----------------------------------------------------

_MESSAGES = "try_variant_get({v}, '$.messages', 'array<variant>')"
_ROLE = "try_variant_get(m, '$.role', 'string')"
_ROLE_IS_KNOWN = f"coalesce({_ROLE} IN ('system', 'user', 'assistant'), false)"
_CONTENT_IS_TEXT = "coalesce(schema_of_variant(try_variant_get(m, '$.content', 'variant')) = 'STRING', false)"


def row_violation(value: str) -> Column:
    """The first broken rule of a chat row, or null."""
    messages = _MESSAGES.format(v=value)
    arms = [
        f"WHEN {messages} IS NULL THEN 'messages must be a list'",
        f"WHEN exists({messages}, m -> NOT {_ROLE_IS_KNOWN}) THEN 'unknown role'",
    ]
    for role in ROLES:
        arms.append(f"WHEN NOT exists({messages}, m -> {_ROLE} = '{role}') THEN 'missing role {role}'")
    for role in ROLES:
        arms.append(f"WHEN size(filter({messages}, m -> {_ROLE} = '{role}')) <> 1 THEN 'more than one {role}'")
    # content rules are checked message by message, in order
    arms.append(
        f"ELSE get(filter(transform({messages}, m -> CASE WHEN NOT {_CONTENT_IS_TEXT} THEN concat('non-string content of ', {_ROLE}) "
        f"WHEN try_variant_get(m, '$.content', 'string') = '' THEN concat('empty content of ', {_ROLE}) END), r -> r IS NOT NULL), 0)"
    )
    return F.expr(f"CASE {' '.join(arms)} END")


def malformed_reasons(value: str) -> Column:
    """All softer findings of a chat row; the row is still measured unless it has no list."""
    messages = _MESSAGES.format(v=value)
    return F.expr(
        f"CASE WHEN {messages} IS NULL THEN array('messages missing or not a list') ELSE "
        f"flatten(transform({messages}, m -> array_compact(array("
        f"CASE WHEN NOT {_ROLE_IS_KNOWN} THEN concat('unexpected role ', coalesce({_ROLE}, 'null')) END, "
        f"CASE WHEN NOT {_CONTENT_IS_TEXT} THEN concat('non-string content in role ', coalesce({_ROLE}, 'null')) END)))) END"
    )


def conversation_contract(turns: DataFrame, key: str, role: str, text: str) -> DataFrame:
    """The same contract over long turns: one verdict per conversation from partial counts."""
    seen = {r: F.count_if(F.col(role) == r).alias(r) for r in ROLES}
    counted = turns.groupBy(key).agg(
        *seen.values(), F.count("*").alias("turns"), F.count_if(F.coalesce(F.col(text), F.lit("")) == "").alias("empty")
    )
    known = sum((F.col(r) for r in ROLES), F.lit(0))
    verdict = F.when(known != F.col("turns"), "unknown role")
    for r in ROLES:
        verdict = verdict.when(F.col(r) == 0, f"missing role {r}")
    for r in ROLES:
        verdict = verdict.when(F.col(r) > 1, f"more than one {r}")
    return counted.withColumn("violation", verdict.when(F.col("empty") > 0, "empty content"))


def prompt_completion(messages: str) -> Column:
    """``struct<prompt, completion>`` in original order; null for an unknown role or an empty side."""
    col = F.col(messages)
    prompt = F.filter(col, lambda m: m["role"].isin("system", "user"))
    completion = F.filter(col, lambda m: m["role"] == "assistant")
    usable = (F.size(prompt) + F.size(completion) == F.size(col)) & (F.size(prompt) > 0) & (F.size(completion) > 0)
    return F.when(usable, F.struct(prompt.alias("prompt"), completion.alias("completion")))


def prompt_only(messages: str) -> Column:
    """Messages without the assistant turn, so gold cannot leak into a prompt."""
    return F.filter(messages, lambda m: m["role"].isin("system", "user"))


# --- audits -------------------------------------------------------------------------


def record_findings(rows: DataFrame, record: str, node: Node = TARGET) -> DataFrame:
    """The audit flags that need the record alone, so that a join after it can do without the record.

    Forbidden keys need the walk, which runs only over rows outside the closed schema.
    """
    loose = once(rows, assistant_schema_invalid=~schema_valid(record, node))
    return loose.withColumns(
        {
            "assistant_forbidden_paths": has_forbidden(F.when(F.col("assistant_schema_invalid"), F.col(record))),
            "assistant_false_event_detail_violations": contract.violation_count(record) > 0,
        }
    )


def chat_findings(rows: DataFrame, record: str, user: str, node: Node = TARGET) -> DataFrame:
    """Audit flags per row; rows with findings are kept, only rows without text are dropped later.

    Rows that come with the flags of ``record_findings`` need no record any more.
    """
    if "assistant_schema_invalid" not in rows.columns:
        rows = record_findings(rows, record, node)
    return rows.withColumns(
        {
            "missing_user_messages": F.col(user).isNull(),
            "duplicate_user_message_risks": F.coalesce(header_count(F.col(user)) != 1, F.lit(False)),
        }
    )


def chat_audit(findings: DataFrame, record: str, key: str, split: str = "split") -> DataFrame:
    """Per split: rows, written rows and rows per finding.

    Findings are counted on rows that have a text, forbidden keys once per key. The rows are read
    once: they are added up per key, which a join by key has brought together, then per split.
    """
    text = ~F.col("missing_user_messages")
    flags = [c for c in CRITICAL if c not in ("missing_user_messages", "assistant_forbidden_paths")]
    per_key = findings.groupBy(split, key).agg(
        F.count("*").alias("rows"), F.count_if(text).alias("written"),
        F.count_if("missing_user_messages").alias("missing_user_messages"),
        *[F.count_if(text & F.col(c)).alias(c) for c in flags],
        F.max(text & F.col("assistant_forbidden_paths")).cast("long").alias("assistant_forbidden_paths"),
    )
    # no split, no forbidden keys: these are counted by split
    named = per_key.withColumn("assistant_forbidden_paths", F.when(F.col(split).isNull(), 0).otherwise(F.col("assistant_forbidden_paths")))
    return named.groupBy(split).agg(*[F.sum(c).alias(c) for c in ("rows", "written", "missing_user_messages", *flags, "assistant_forbidden_paths")])


def audit_details(findings: DataFrame, record: str, key: str, split: str = "split", node: Node = TARGET) -> DataFrame:
    """``split, finding, key, details``: the notes behind every count of the audit.

    ``details`` holds the first ``SHOWN_MESSAGES`` schema messages, the first ``SHOWN_PATHS``
    forbidden or broken places of a note, and is empty for the other findings. Only notes with
    a finding are walked; what goes beyond the first ones of a note is dropped before the shuffle.
    """
    text = ~F.col("missing_user_messages")
    nothing = F.expr("CAST(array() AS ARRAY<STRING>)")

    def of(rows: DataFrame, finding: str, details: Column = nothing) -> DataFrame:
        return rows.select(split, F.lit(finding).alias("finding"), key, details.alias("details"))

    loose = findings.where(text & F.col("assistant_schema_invalid")).select(split, key, record)
    invalid = validity_detail(loose, record, node, key, SHOWN_MESSAGES)
    order = Window.partitionBy(split, key).orderBy(path_order("pointer"))
    forbidden = forbidden_paths(loose, record, [split, key]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN_PATHS)
    forbidden = forbidden.groupBy(split, key).agg(F.sort_array(F.collect_list(F.struct("rank", "pointer"))).alias("f"))
    broken = findings.where(text & F.col("assistant_false_event_detail_violations"))
    parts = [
        of(findings.where(~text), "missing_user_messages"),
        of(findings.where(text & F.col("duplicate_user_message_risks")), "duplicate_user_message_risks"),
        of(invalid.join(loose.select(split, key), key).where(~F.col("valid")), "assistant_schema_invalid",
           F.transform("errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"]))),
        of(forbidden, "assistant_forbidden_paths", F.col("f.pointer")),
        of(broken, "assistant_false_event_detail_violations", F.slice(contract.violation_places(record), 1, SHOWN_PATHS)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def audit_verdict(audit: DataFrame, split: str = "split") -> DataFrame:
    """``split, finding, n``: every non-empty critical list."""
    return audit.unpivot([split], list(CRITICAL), "finding", "n").where(F.col("n") > 0)


def role_counts(turns: DataFrame, role: str = "role", split: str = "split") -> DataFrame:
    return turns.groupBy(split, role).agg(F.count("*").alias("n"))


def token_gate(rows: DataFrame, tokens: str, malformed: str, limit: int = MAX_SEQ_LENGTH) -> DataFrame:
    """One row: largest row, rows over the limit, malformed findings and ``pass``."""
    totals = rows.agg(
        F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"),
        F.count_if(F.col(tokens) > limit).alias("over_limit_count"),
        F.coalesce(F.sum(F.size(malformed)), F.lit(0)).alias("malformed_count"),
    )
    fine = (F.col("max_tokens") <= limit) & (F.col("over_limit_count") == 0) & (F.col("malformed_count") == 0)
    return totals.withColumn("pass", fine)


def enforce_token_gate(rows: DataFrame, tokens: str, limit: int = MAX_SEQ_LENGTH) -> DataFrame:
    """Fails the job at the first row over the limit instead of cutting it."""
    too_long = F.concat(F.lit("row of "), F.col(tokens).cast("string"), F.lit(f" tokens exceeds {limit}"))
    return rows.where(F.when(F.col(tokens) > limit, F.raise_error(too_long)).otherwise(F.lit(True)))


def whitespace_tokens(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def count_tokens(
    df: DataFrame, text: str, counter: Column | Callable[[Sequence[str]], Sequence[int]] | None = None, out: str = "tokens"
) -> DataFrame:
    """Adds token counts by a column expression (default: the proxy) or a batch function.

    The function gets the texts of an Arrow batch; it is where an external tokenizer plugs in.
    """
    if counter is None or isinstance(counter, Column):
        return df.withColumn(out, token_proxy(F.col(text)) if counter is None else counter)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def measure(batches: Iterator) -> Iterator:
        for batch in batches:
            batch[out] = list(counter(batch[text].tolist()))
            yield batch

    return df.mapInPandas(measure, schema)
