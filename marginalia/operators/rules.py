"""Schema findings as set operations: the node walk joined to the rule table."""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from typing import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marginalia.functions import variant_bytes as B
from marginalia.functions.variants import schema_valid
from marginalia.operators.walk import BATCH_NODES, VALUE, _values, escaped, leaf_json, node_counts, scalar
from marginalia.schema import RULE_TYPE, Node, rule_rows, rule_table
from marginalia.session import once

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINDING = "STRUCT<keyword: STRING, message: STRING>"
FOUND = pa.list_(pa.struct([(c, pa.string()) for c in ("path", "keyword", "message")]))
KEYWORDS = ("type", "required", "additionalProperties", "enum", "const", "pattern", "minimum", "minItems")

#: Field of the rule table that a keyword needs; every node has a type.
NEEDS = {"required": "required", "additionalProperties": "closed", "enum": "enum_values", "const": "const_value",
         "pattern": "pattern", "minimum": "minimum", "minItems": "min_items"}


def _concerned(row: tuple, keywords: Sequence[str]) -> bool:
    """Whether a node of the schema has a rule of the wanted keywords."""
    fields = dict(zip(RULE_TYPE.names, row))
    return "type" in keywords or any(fields[NEEDS[k]] not in (None, False, []) for k in keywords)


#: Regular expressions that Java and Python read alike on a line of ASCII.
ALIKE = re.compile(r"(?:[A-Za-z0-9/|(){},^$ _-]|\\d|\[[A-Za-z0-9-]+\])*")
SUSPECT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("pointer", "pattern", "type", "value")]
    + [T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("size", T.IntegerType())])
SUSPECT_TYPES = [*[pa.string()] * 4, pa.list_(pa.string()), pa.int32()]
UNSURE = -1


class Suspicion:
    """A pattern of the schema: which of its nodes may break a rule of the wanted keywords, and the patterns below.

    No node that breaks one is passed over; whether a suspect does is left to the tests after the walk.
    """

    def __init__(self, row: tuple, keywords: Sequence[str]):
        rule = {k: v for k, v in zip(RULE_TYPE.names, row)}
        has = lambda k: rule[NEEDS[k]] if k in keywords else None
        self.pattern, self.below, self.concerned = rule["path"], {}, _concerned(row, keywords)
        self.types = frozenset(rule["types"] + ["integer"] * ("number" in rule["types"])) if "type" in keywords else None
        self.enum, self.const, self.minimum, self.min_items = has("enum"), has("const"), has("minimum"), has("minItems")
        self.required, self.known = frozenset(has("required") or ()), frozenset(rule["known_keys"]) if has("additionalProperties") else None
        self.like, self.tried = has("pattern"), None
        if self.like is not None and ALIKE.fullmatch(self.like):
            self.tried = re.compile(self.like, re.ASCII)

    def broken(self, kind: str, text: str | None, keys: list[str] = (), size: int | None = None) -> int:
        """How many findings a node gives; UNSURE if a text is left for Java to match."""
        n = int(self.types is not None and kind not in self.types)
        n += bool(self.enum) and not (kind == "string" and text in self.enum)
        n += self.const is not None and not (kind == "string" and text == self.const)
        if kind == "object":
            n += len(self.required.difference(keys)) + (self.known is not None and not self.known.issuperset(keys))
        elif kind == "array":
            n += self.min_items is not None and size < self.min_items
        elif kind == "string":
            if self.like is not None:
                if self.tried is None or not (text.isascii() and text.isprintable()):
                    return UNSURE
                n += not self.tried.search(text)
        elif self.minimum is not None and kind in ("integer", "number"):
            n += float(text) < self.minimum
        return n


def _suspicions(rows: list[tuple], keywords: Sequence[str]) -> Suspicion:
    """The root of the schema's patterns."""
    made = {row[0]: Suspicion(row, keywords) for row in rows}
    for pattern, one in made.items():
        if pattern:
            above, _, last = pattern.rpartition("/")
            made[above].below["*" if last == "*" else last.replace("~1", "/").replace("~0", "~")] = one
    return made[""]


def _order(path: str) -> list[str]:
    """The order of ``path_order``."""
    return [""] if path == "<root>" else [p.zfill(10) if re.match("[0-9]+$", p) else p for p in path.split("/")]


def _first_suspects(found: list[tuple], first: int) -> tuple[list[tuple], int]:
    """The root and the suspects that hold the ``first`` findings by path, or more, and how many findings the others hold."""
    if sum(n for *_, n in found if n > 0) <= first:
        return found, 0
    root, *others = found
    placed = sorted(((_order(one[0][1:]), one) for one in others), key=lambda x: x[0])
    kept, seen, more, last = [root], max(root[-1], 0), 0, [""]
    for place, one in placed:
        # what stands at the same place is told apart by its messages, which come later
        if one[-1] == UNSURE or seen < first or place == last:
            kept.append(one)
            seen, last = seen + max(one[-1], 0), place
        else:
            more += one[-1]
    return kept, more


def _suspects(root: Suspicion, whole: bool, first: int):
    """Walks VARIANTs, the last column, and gives out the suspects.

    With ``whole`` the root of each comes before them in any case, and nulls for SQL NULL. With ``first`` only
    the suspects with so many findings come, and ``more`` says with the root how many findings the others hold.
    """

    def visit(data: bytes, at: int, keys: B.Keys, one: Suspicion, above: str, last: str | None, add) -> None:
        head = data[at]
        kind = head & 3
        if kind == B.OBJECT:
            ids, offsets, base = B.fields(data, at, head)
            pointer = "" if last is None else f"{above}/{last}"
            found = keys.notes.get((one, ids))
            if found is None:
                if len(keys.notes) >= 10_000:
                    keys.notes.clear()
                names = [keys[i] for i in ids]
                n = one.broken("object", None, names) if one.concerned else 0
                found = keys.notes[one, ids] = names, n, [(n, one.below[k], escaped(k)) for n, k in enumerate(names) if k in one.below]
            names, n, below = found
            if n or (whole and last is None):
                add((pointer, one.pattern, "object", None, names, None, n))
            for n, part, name in below:
                visit(data, base + offsets[n], keys, part, pointer, name, add)
        elif kind == B.ARRAY:
            offsets, base = B.elements(data, at, head)
            pointer = "" if last is None else f"{above}/{last}"
            n = one.broken("array", None, (), len(offsets)) if one.concerned else 0
            if n or (whole and last is None):
                add((pointer, one.pattern, "array", None, None, len(offsets), n))
            part = one.below.get("*")
            if part is not None:
                for n, offset in enumerate(offsets):
                    visit(data, base + offset, keys, part, pointer, str(n), add)
        elif one.concerned or (whole and last is None):
            name, text = scalar(data[at + 1:at + 1 + (head >> 2)].decode() if kind else B.primitive(data, at, head >> 2))
            n = one.broken(name, text) if one.concerned else 0
            if n or (whole and last is None):
                add(("" if last is None else f"{above}/{last}", one.pattern, name, text, None, None, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.schema.names[:-1]
            out: list[tuple] = []
            more: list[int | None] = []
            rows: list[int] = []

            def flush() -> pa.RecordBatch:
                beside = [batch.column(c).take(pa.array(rows, pa.int32())) for c in kept]
                columns = list(zip(*out))[:-1] if out else [()] * len(SUSPECT_TYPES)
                nodes = [pa.array(column, t) for column, t in zip(columns, SUSPECT_TYPES)]
                return pa.RecordBatch.from_arrays(beside + nodes + [pa.array(more, pa.int64())], names=kept + SUSPECT.names + ["more"])

            for number, value in enumerate(B.values(batch.column(batch.num_columns - 1))):
                found: list[tuple] = []
                rest = None
                if value is not None:
                    visit(value[0], 0, value[1], root, "", None, found.append)
                    if first:
                        found, rest = _first_suspects(found, first)
                elif whole:
                    found.append((None,) * (len(SUSPECT_TYPES) + 1))
                out += found
                more += [rest] + [None] * (len(found) - 1) if found else []
                rows += [number] * len(found)
                if len(rows) >= BATCH_NODES:
                    yield flush()
                    out, more, rows = [], [], []
            yield flush()

    return run


def _tested(
    df: DataFrame, value: str, node: Node, keep: Sequence[str], keywords: Sequence[str], bare: bool = False, first: int = 0
) -> DataFrame:
    """``keep``, ``path``, ``pattern`` and ``found``, the list of broken keywords, of each node that may break a rule of the wanted keywords.

    The walk passes over nodes that keep their rules for sure. The wanted keywords of the others, and
    no others, are tested in one projection after the one broadcast join. A missing key is found on its parent, whose node carries its own key list.
    With ``bare``, the root of each document comes out first in any case, and rows without a document once, with null ``pattern`` and ``found``.
    With ``first`` as well, nodes beyond those that hold so many findings by path are left out; ``more``, beside the root, counts their findings.
    """
    text, number = "value", "CAST(value AS DOUBLE)"
    type_ok = "(array_contains(types, type) OR (type = 'integer' AND array_contains(types, 'number')))"
    tests = {
        "type": (f"NOT {type_ok}", "concat(shown, ' is not of type ', array_join(types, ', '))"),
        "enum": (
            f"enum_values IS NOT NULL AND NOT (type = 'string' AND array_contains(enum_values, {text}))",
            "concat(shown, ' is not one of ', to_json(enum_values))",
        ),
        "const": (
            f"const_value IS NOT NULL AND NOT (type = 'string' AND {text} = const_value)",
            "concat('\"', const_value, '\" was expected')",
        ),
        "pattern": (
            f"rule_pattern IS NOT NULL AND type = 'string' AND NOT {text} RLIKE rule_pattern",
            "concat(shown, ' does not match ', rule_pattern)",
        ),
        "minimum": (
            f"minimum IS NOT NULL AND type IN ('integer', 'number') AND {number} < minimum",
            "concat(shown, ' is less than the minimum of ', minimum)",
        ),
        "minItems": (
            "min_items IS NOT NULL AND type = 'array' AND size < min_items",
            "concat('has fewer than ', min_items, ' items')",
        ),
        "additionalProperties": (
            "closed AND type = 'object' AND size(array_except(keys, known_keys)) > 0",
            "concat('unexpected keys: ', array_join(array_except(keys, known_keys), ', '))",
        ),
    }
    single = ", ".join(
        f"CASE WHEN {test} THEN named_struct('keyword', '{kw}', 'message', {message}) END"
        for kw, (test, message) in tests.items() if kw in keywords
    )
    missing = (
        "CASE WHEN type = 'object' THEN transform(array_except(required, keys), "
        "k -> named_struct('keyword', 'required', 'message', concat('\\'', k, '\\' is a required property'))) "
        "ELSE array() END"
    )
    lists = ([f"array_compact(array({single}))"] if single else []) + ([missing] if "required" in keywords else [])
    shown = F.when(F.col("type").isin("object", "array"), F.col("type")).otherwise(leaf_json())
    every = rule_rows(node)
    wanted = [row for row in every if _concerned(row, keywords)]
    rules = df.sparkSession.createDataFrame(wanted, RULE_TYPE).withColumnRenamed("pattern", "rule_pattern")
    values = _values(df, value, keep, bare)
    spec = T.StructType([*values.drop(VALUE).schema.fields, *SUSPECT.fields, T.StructField("more", T.LongType())])
    nodes = (
        values.mapInArrow(_suspects(_suspicions(every, keywords), bare, first), spec)
        .join(F.broadcast(rules.withColumnRenamed("path", "pattern")), "pattern", "left" if bare else "inner")
        .withColumn("shown", shown)
    )
    path = F.when(F.col("pointer") == "", F.lit("<root>")).otherwise(F.substr("pointer", F.lit(2)))
    return nodes.select(*keep, path.alias("path"), "pattern", F.expr(f"concat({', '.join(lists)})").alias("found"), "more")


def schema_findings(
    df: DataFrame, value: str, node: Node, keep: Sequence[str], keywords: Sequence[str] = KEYWORDS
) -> DataFrame:
    """One row per violation: ``keep``, ``path``, ``pattern``, ``keyword``, ``message``."""
    found = _tested(df, value, node, keep, keywords).select(*keep, "path", "pattern", F.explode("found").alias("f"))
    return found.select(*keep, "path", "pattern", "f.keyword", "f.message")


def path_order_sql(path: str) -> str:
    part = "CASE WHEN p RLIKE '^[0-9]+$' THEN lpad(p, greatest(10, length(p)), '0') ELSE p END"
    return f"CASE WHEN {path} = '<root>' THEN array('') ELSE transform(split({path}, '/'), p -> {part}) END"


def path_order(path: str) -> Column:
    """Sort key of a slash path: part by part, list positions as numbers, the root first."""
    return F.expr(path_order_sql(path))


def _place(finding: tuple[str, str, str]) -> tuple[list[str], str, str]:
    """The order of ``path_order``, then keyword and message."""
    path, keyword, message = finding
    return _order(path), keyword, message


def _first_findings(shown: int):
    """Folds the findings of a row, which follow its row without keyword, into their number and the first ones; findings that were left out stand as ``more`` with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, found, count = None, [], 0

        def folded(rows: list[tuple]) -> pa.RecordBatch:
            kept = [[{"path": p, "keyword": k, "message": m} for p, k, m in first] for *_, first in rows]
            keys = [key for key, *_ in rows]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys) if keys else empty, pa.array([v for _, v, *_ in rows], pa.bool_()),
                 pa.array([n for *_, n, _ in rows], pa.int64()), pa.array(kept, FOUND)], names=names)

        for batch in batches:
            names, empty = [batch.schema.names[0], "valid", "error_count", "first"], batch.column(0).slice(0, 0)
            done = []
            for i, (valid, path, more, keyword, message) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if keyword is None:
                    if row:
                        done.append((*row, count, heapq.nsmallest(shown, found, _place)))
                    row, found, count = (batch.column(0).slice(i, 1), valid), [], more or 0
                else:
                    count += 1
                    found.append((path, keyword, message))
            yield folded(done)
        if row:
            yield folded([(*row, count, heapq.nsmallest(shown, found, _place))])

    return run


def validity_detail(df: DataFrame, value: str, node: Node, key: str, shown: int = 10) -> DataFrame:
    """``key, valid, error_count, errors`` per row; at most ``shown`` errors by path.

    Paths are ordered part by part, list positions as numbers, the root first.
    Validity itself is a per-row expression. The input is read once: only invalid rows are
    walked, the findings of a row are counted and cut to the first ``shown``, give or take those
    of one node, where it is walked, and these alone are tested, worded and shuffled. Rows of one key share their findings.
    """
    flagged = once(df.select(key, value), valid=schema_valid(value, node))
    walked = flagged.select(key, "valid", F.when(~F.col("valid"), F.col(value)).alias(value))
    nodes = _tested(walked, value, node, [key, "valid"], KEYWORDS, bare=True, first=shown)
    # each row begins with its root, or stands alone where nothing was walked
    start = F.when(F.coalesce("pattern", F.lit("")) == "", F.array(F.expr(f"CAST(NULL AS {FINDING})")))
    none = F.expr(f"CAST(array() AS ARRAY<{FINDING}>)")
    listed = F.concat(F.coalesce(start, none), F.coalesce("found", none))
    findings = nodes.select(key, "valid", "path", "more", F.explode(listed).alias("f")).select(
        key, "valid", "path", "more", "f.keyword", "f.message")
    spec = T.StructType([findings.schema[key], T.StructField("valid", T.BooleanType()), T.StructField("error_count", T.LongType()),
                         T.StructField("first", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("path", "keyword", "message")])))])
    rows = findings.mapInArrow(_first_findings(shown), spec)
    per_key = rows.groupBy(key).agg(
        F.collect_list("valid").alias("valid"), F.sum("error_count").alias("error_count"), F.flatten(F.collect_list("first")).alias("first"))
    order = F.expr("transform(first, f -> struct(" + path_order_sql("f.path") + " AS o, f.keyword AS k, f.message AS message, f.path AS path))")
    errors = F.transform(F.slice(F.array_sort(order), 1, shown), lambda e: F.struct(e.path.alias("path"), e.message.alias("message")))
    # rows without a key share nothing
    known, empty = F.col(key).isNotNull(), F.expr("CAST(array() AS ARRAY<STRUCT<path: STRING, message: STRING>>)")
    return per_key.select(
        key, F.explode("valid").alias("valid"), F.when(known, F.col("error_count")).otherwise(0).cast("long").alias("error_count"),
        F.when(known, errors).otherwise(empty).alias("errors"))


def rule_coverage(df: DataFrame, value: str, node: Node, keep: Sequence[str]) -> DataFrame:
    """Per schema node: its rule and how many nodes of the data it governs."""
    nodes = node_counts(df, value).groupBy("pattern").agg(F.sum("n").alias("nodes"))
    rules = rule_table(df.sparkSession, node)
    return rules.join(
        nodes.withColumnRenamed("pattern", "path"), "path", "left"
    ).withColumn("nodes", F.coalesce("nodes", F.lit(0)))
