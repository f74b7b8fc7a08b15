"""Text renderings of nested values for flat exports and error tables."""

from __future__ import annotations

import json
import sys
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from marginalia.functions import variant_bytes as B
from marginalia.functions.sqltext import Names, quote
from marginalia.schema import Node

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Separators, labels and widths of the flat export.
FIELD_SEPARATOR = " | "
ITEM_SEPARATOR = " ; "
EDITED = "Validado con edicion"
UNEDITED = "Validado sin edicion"
UNNAMED_EDITOR = "S/D"
SHOWN_WIDTH = 60


def scalar_at(variant: str, path: str) -> Column:
    """Text of the value at a dotted path; empty where missing or null."""
    return F.coalesce(F.expr(f"try_variant_get({variant}, {quote('$.' + path)}, 'string')"), F.lit(""))


def flatten_typed_sql(value: str, node: Node, names: Names | None = None) -> str:
    """SQL text of a typed value: fields ``k=v`` joined by bars, items joined by semicolons."""
    names = names or Names("t")
    if node.kind == "object":
        parts = ", ".join(
            f"concat({quote(k + '=')}, {flatten_typed_sql(f'{value}.{k}', c, names)})" for k, c in node.props.items()
        )
        return f"CASE WHEN {value} IS NULL THEN '' ELSE concat_ws({quote(FIELD_SEPARATOR)}, {parts}) END"
    if node.kind == "array":
        x = names()
        items = f"transform({value}, {x} -> {flatten_typed_sql(x, node.item, names)})"
        return f"CASE WHEN {value} IS NULL THEN '' ELSE array_join({items}, {quote(ITEM_SEPARATOR)}) END"
    return f"coalesce(CAST({value} AS STRING), '')"


def flatten_typed(value: str, node: Node) -> Column:
    return F.expr(flatten_typed_sql(value, node))


def key_order(node: Node | None) -> dict | None:
    """Declared keys of a record in order, each with the order of the records below it; lists count as their items."""
    while node is not None and node.kind == "array":
        node = node.item
    return {k: key_order(c) for k, c in node.props.items()} if node is not None and node.kind == "object" else None


def flat_text(value: Any, order: dict | None) -> str:
    """A parsed value as text: fields ``k=v`` joined by bars, items by semicolons, at any depth.

    Declared keys come first, in declared order, the others after them as they stand.
    """
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        order = order or {}
        keys = [k for k in order if k in value] + [k for k in value if k not in order]
        return FIELD_SEPARATOR.join([f"{k}={flat_text(value[k], order.get(k))}" for k in keys])
    if isinstance(value, list):
        return ITEM_SEPARATOR.join([flat_text(item, order) for item in value])
    return str(value)


def flatten_json(text: Column, node: Node | None = None) -> Column:
    """JSON text of any shape and depth as flat text; empty for null.

    Without ``node`` keys stay in the order of the text. The work goes by Arrow batches.
    """
    order = key_order(node)

    def flat(texts: pd.Series) -> pd.Series:
        sys.setrecursionlimit(20_000)  # a parsed VARIANT has at most a thousand levels
        return pd.Series([flat_text(json.loads(t, parse_float=str), order) if t else "" for t in texts.tolist()], dtype=object)

    return F.pandas_udf(flat, "string")(text)


def list_at(variant: str, path: str, node: Node | None = None) -> Column:
    """A list at a dotted path, items joined; empty where missing, null or no list."""
    at = quote("$." + path)
    listed = f"try_variant_get({variant}, {at}, 'array<variant>') IS NOT NULL"
    return flatten_json(F.expr(f"CASE WHEN {listed} THEN to_json(try_variant_get({variant}, {at}, 'variant')) END"), node)


def list_cells(variant: Column, paths: dict[str, str], nodes: dict[str, Node]) -> Column:
    """``list_at`` of several paths, by the names of the struct they make; the VARIANT is read once and from its bytes.

    ``nodes`` has the records of a path with declared keys.
    """
    ways = [(name, path.split("."), key_order(nodes.get(path))) for name, path in paths.items()]

    def cell(data: bytes, keys: list[str], way: list[str], order: dict | None) -> str:
        at: int | None = 0
        for key in way:
            at = B.member(data, at, keys, key)
            if at is None:
                return ""
        return flat_text(B.decode(data, at, keys), order) if data[at] & 3 == B.ARRAY else ""

    def cells(column: pd.Series) -> pd.DataFrame:
        sys.setrecursionlimit(B.LEVELS)  # a parsed VARIANT has at most a thousand levels
        read = [(v.value, B.keys_of(v.metadata)) if v is not None else None for v in column]
        return pd.DataFrame({
            name: pd.Series([cell(*v, way, order) if v else "" for v in read], dtype=object) for name, way, order in ways})

    return F.pandas_udf(cells, ", ".join(f"`{name}` string" for name in paths))(variant)


def _review(variant: str, field: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({variant}, '$.validacion_humana.{field}', '{kind}')")


def review_status(variant: str) -> Column:
    edited = F.coalesce(_review(variant, "modificada", "boolean"), F.lit(False))
    return F.when(edited, F.lit(EDITED)).otherwise(F.lit(UNEDITED))


def review_editor(variant: str, unnamed: str = UNNAMED_EDITOR) -> Column:
    """Who edited the note; ``unnamed`` where an edited note names nobody, empty where it was not edited."""
    edited = F.coalesce(_review(variant, "modificada", "boolean"), F.lit(False))
    user = F.nullif(_review(variant, "usuario_validador", "string"), F.lit(""))
    return F.when(edited, F.coalesce(user, F.lit(unnamed))).otherwise(F.lit(""))


def review_tags(variant: str) -> Column:
    return F.coalesce(F.array_join(_review(variant, "tags_topicos", "array<string>"), "; "), F.lit(""))


def shown(value: Column) -> Column:
    """A slot value for a table cell: a dash for null, long text cut."""
    cut = F.concat(F.substring(value, 1, SHOWN_WIDTH - 3), F.lit("..."))
    return F.when(value.isNull(), F.lit("—")).when(F.length(value) > SHOWN_WIDTH, cut).otherwise(value)


def rendered(variant: str) -> Column:
    """A value as text: ``null``, JSON for containers, plain text otherwise."""
    return F.expr(f"coalesce(try_variant_get({variant}, '$', 'string'), 'null')")
