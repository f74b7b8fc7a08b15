"""Leaf comparison of two schema-valid records as one expression per row.

Gold and prediction meet in one row (one equi join by note), so comparing their leaves
needs neither an explode nor a second shuffle. The expression is written from the schema:
records pair their fields by name, lists pair their items by position. Both sides must be
schema-valid, so that keys are never missing and only declared values are null;
``marginalia.operators.leafjoin`` compares arbitrary JSON.

Rules:

* two primitives at one path: equal is a true positive, different is both a false
  positive and a false negative;
* a leaf without partner is a false negative (gold) or a false positive (prediction);
* null against a record or list: the null is not counted, the other side's leaves are
  one-sided; null against null is a match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.sqltext import Names, bind, total
from marginalia.schema import Node


def _has_nullable_container(node: Node) -> bool:
    inner = list(node.props.values()) + ([node.item] if node.item else [])
    return any((c.is_container and c.nullable) or _has_nullable_container(c) for c in inner)


def _sum_items(items: str) -> str:
    return f"aggregate({items}, 0, (acc, n) -> acc + n)"


def _nullable(value: str, node: Node, when_null: str, otherwise: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN {when_null} ELSE {otherwise} END" if node.nullable else otherwise


def leaf_count(value: str, node: Node, names: Names) -> str:
    """Leaves below ``value``; a null record or list is one leaf."""
    if not node.is_container:
        return "1"
    if node.kind == "object":
        inside = total([leaf_count(f"{value}.{k}", c, names) for k, c in node.props.items()])
    else:
        x = names()
        each = leaf_count(x, node.item, names)
        inside = f"(size({value}) * {each})" if each.isdigit() else _sum_items(f"transform({value}, {x} -> {each})")
    return _nullable(value, node, "1", inside)


def empty_leaf_count(value: str, node: Node, names: Names) -> str:
    """Leaves below ``value`` that are null or an empty string."""
    if not node.is_container:
        return f"CAST({_blank(value, node)} AS INT)"
    if node.kind == "object":
        inside = total([empty_leaf_count(f"{value}.{k}", c, names) for k, c in node.props.items()])
    else:
        x = names()
        inside = _sum_items(f"transform({value}, {x} -> {empty_leaf_count(x, node.item, names)})")
    return _nullable(value, node, "1", inside)


def _blank(value: str, node: Node) -> str:
    return f"(coalesce({value}, '') = '')" if node.kind == "string" else f"({value} IS NULL)"


def _both(gold: str, pred: str, node: Node, one_null: str, otherwise: str) -> str:
    """Null handling of a container pair: null against null is one matched leaf."""
    if not node.nullable:
        return otherwise
    return (
        f"CASE WHEN {gold} IS NULL AND {pred} IS NULL THEN 1 "
        f"WHEN {gold} IS NULL OR {pred} IS NULL THEN {one_null} ELSE {otherwise} END"
    )


def _matches(gold: str, pred: str, node: Node, names: Names) -> str:
    if not node.is_container:
        return f"CAST({gold} <=> {pred} AS INT)"
    if node.kind == "object":
        inside = total([_matches(f"{gold}.{k}", f"{pred}.{k}", c, names) for k, c in node.props.items()])
    else:
        x, y = names(), names()
        item = _matches(x, y, node.item, names)
        if node.item.is_container:
            item = f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 0 ELSE {item} END"
        inside = _sum_items(f"zip_with({gold}, {pred}, ({x}, {y}) -> {item})")
    return _both(gold, pred, node, "0", inside)


def _counted(side: str, other: str, node: Node, names: Names) -> str:
    """Leaves of ``side`` that take part, given what ``other`` holds at the same path."""
    if not node.is_container:
        return "1"
    if not _has_nullable_container(node):
        inside = leaf_count(side, Node(**{**node.__dict__, "nullable": False}), names)
    elif node.kind == "object":
        inside = total([_counted(f"{side}.{k}", f"{other}.{k}", c, names) for k, c in node.props.items()])
    else:
        x, y = names(), names()
        inside = _sum_items(
            f"zip_with({side}, coalesce({other}, array()), ({x}, {y}) -> CASE WHEN {x} IS NULL THEN 0 "
            f"WHEN {y} IS NULL THEN {leaf_count(x, node.item, names)} "
            f"ELSE {_counted(x, y, node.item, names)} END)"
        )
    return _nullable(side, node, f"CAST({other} IS NULL AS INT)", inside)


def leaf_f1_counts(gold: str, pred: str, node: Node) -> Column:
    """``struct<tp, fp, fn, gold_leaves, pred_leaves>`` of two record columns.

    Every counted gold leaf is a match or a false negative and every counted predicted
    leaf is a match or a false positive, so three sums give all five numbers.
    """
    names = Names()
    sums = (
        f"named_struct('tp', CAST({_matches(gold, pred, node, names)} AS BIGINT), "
        f"'g', CAST({_counted(gold, pred, node, names)} AS BIGINT), "
        f"'p', CAST({_counted(pred, gold, node, names)} AS BIGINT))"
    )
    return F.expr(
        bind(sums, "c", "named_struct('tp', c.tp, 'fp', c.p - c.tp, 'fn', c.g - c.tp, "
                        "'gold_leaves', c.g, 'pred_leaves', c.p)")
    )


def _recall_term(gold: str, pred: str, node: Node, names: Names, what: str) -> str:
    """One recall counter: ``leaves``, ``empty``, ``exact`` or ``filled``."""
    if not node.is_container:
        filled = f"NOT {_blank(gold, node)}"
        return {
            "leaves": "1",
            "empty": f"CAST({_blank(gold, node)} AS INT)",
            "exact": f"CAST(({filled} AND {gold} <=> {pred}) AS INT)",
            "filled": f"CAST(({filled} AND NOT {_blank(pred, node)}) AS INT)",
        }[what]
    alone = {"leaves": leaf_count, "empty": empty_leaf_count}.get(what, lambda *_: "0")
    lone = "1" if what in ("leaves", "empty") else "0"
    both_null = f"{gold} IS NULL AND {pred} IS NULL"
    if node.kind == "array":
        x, y = names(), names()
        item = _recall_term(x, y, node.item, names, what)
        if node.item.is_container:
            item = (
                f"CASE WHEN {x} IS NULL THEN 0 WHEN {y} IS NULL THEN {alone(x, node.item, names)} ELSE {item} END"
            )
        inside = _sum_items(f"zip_with(coalesce({gold}, array()), coalesce({pred}, array()), ({x}, {y}) -> {item})")
        return f"CASE WHEN {both_null} THEN {lone} ELSE {inside} END" if node.nullable else inside
    inside = total([_recall_term(f"{gold}.{k}", f"{pred}.{k}", c, names, what) for k, c in node.props.items()])
    if not node.nullable:
        return inside
    return (
        f"CASE WHEN {both_null} THEN {lone} WHEN {gold} IS NULL THEN 0 "
        f"WHEN {pred} IS NULL THEN {alone(gold, node, names)} ELSE {inside} END"
    )


def leaf_recall_counts(gold: str, pred: str, node: Node) -> Column:
    """``struct<gold_leaves, exact_match, non_empty_recovery, null_or_empty_in_gold>``.

    A gold leaf is recovered exactly, or loosely by any non-empty value at its path. A
    primitive list slot that only the prediction has adds one empty gold leaf.
    """
    names = Names("r")
    fields = {
        "gold_leaves": "leaves",
        "exact_match": "exact",
        "non_empty_recovery": "filled",
        "null_or_empty_in_gold": "empty",
    }
    parts = ", ".join(
        f"'{name}', CAST({_recall_term(gold, pred, node, names, what)} AS BIGINT)"
        for name, what in fields.items()
    )
    return F.expr(f"named_struct({parts})")
