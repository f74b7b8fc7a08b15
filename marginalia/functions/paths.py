"""Wildcard paths over typed records and the aligned slots of two records."""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column, functions as F

from marginalia.functions.sqltext import Names, bind, quote
from marginalia.schema import Node


def path_tokens(path: str) -> list[str]:
    """``a.b[].c`` as ``['a', 'b', '[]', 'c']``."""
    return re.findall(r"\[\]|[^.\[\]]+", path)


def leaf_node(node: Node, path: str) -> Node:
    for token in path_tokens(path):
        node = node.item if token == "[]" else node.props[token]
    return node


def resolve_sql(value: str, node: Node, path: str, names: Names | None = None) -> str:
    """SQL array of all values at ``path``, as strings.

    Every list on the way contributes its items in order; a null record or list
    contributes nothing, a null leaf contributes a null.
    """
    names = names or Names("v")

    def step(expr: str, at: Node, tokens: list[str]) -> str:
        if not tokens:
            return f"array(CAST({expr} AS STRING))"
        token, rest = tokens[0], tokens[1:]
        if token == "[]":
            x = names()
            return f"flatten(transform(coalesce({expr}, array()), {x} -> {step(x, at.item, rest)}))"
        inner = step(f"{expr}.{token}", at.props[token], rest)
        return f"CASE WHEN {expr} IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE {inner} END"

    return step(value, node, path_tokens(path))


def resolve_path(value: str, node: Node, path: str) -> Column:
    return F.expr(resolve_sql(value, node, path))


def path_counts(gold: str, pred: str, node: Node, paths: Iterable[tuple[str, str]]) -> Column:
    """``array<struct<path, tp, tn, fp, fn>>``: one entry per path, values aligned by position.

    Values align in the flattened list of the whole note. Two nulls are skipped; a value
    on one side only is a false negative (gold) or false positive (prediction); a wrong
    value is both; equal false booleans are true negatives.
    """
    names = Names("q")
    entries = []
    for label, path in paths:
        x, y, kinds, k = names(), names(), names(), names()
        equal = "'tp'"
        if leaf_node(node, path).kind == "boolean":
            equal = f"CASE WHEN {x} = 'true' THEN 'tp' ELSE 'tn' END"
        codes = (
            f"zip_with({resolve_sql(gold, node, path, names)}, {resolve_sql(pred, node, path, names)}, "
            f"({x}, {y}) -> CASE WHEN {x} IS NULL AND {y} IS NULL THEN 'skip' WHEN {y} IS NULL THEN 'fn' "
            f"WHEN {x} IS NULL THEN 'fp' WHEN {x} = {y} THEN {equal} ELSE 'wrong' END)"
        )

        def tally(*wanted: str) -> str:
            inside = ", ".join(quote(w) for w in wanted)
            return f"CAST(size(filter({kinds}, {k} -> {k} IN ({inside}))) AS BIGINT)"

        body = (
            f"named_struct('path', {quote(label)}, 'tp', {tally('tp')}, 'tn', {tally('tn')}, "
            f"'fp', {tally('fp', 'wrong')}, 'fn', {tally('fn', 'wrong')})"
        )
        entries.append(bind(codes, kinds, body))
    return F.expr(f"array({', '.join(entries)})")


def headline_counts(gold: str, pred: str, path: str) -> Column:
    """Confusion entry of one boolean; null where either side is missing."""
    g, p = f"{gold}.{path}", f"{pred}.{path}"
    return F.expr(
        f"CASE WHEN {g} IS NOT NULL AND {p} IS NOT NULL THEN named_struct('path', {quote(path)}, "
        f"'tp', CAST({g} AND {p} AS BIGINT), 'tn', CAST(NOT {g} AND NOT {p} AS BIGINT), "
        f"'fp', CAST(NOT {g} AND {p} AS BIGINT), 'fn', CAST({g} AND NOT {p} AS BIGINT)) END"
    )


def slot_pairs(gold: str, pred: str, node: Node, paths: Iterable[tuple[str, str]]) -> Column:
    """``array<struct<path_no, path, slot, gold, pred, kind, strict_kind>>`` over all paths.

    ``kind`` treats a null as absent (match, missing, extra, mismatch); ``strict_kind``
    goes by list length only (match, mismatch, fn_missing_pred, fp_extra_pred).
    """
    names = Names("s")
    per_path = []
    for number, (label, path) in enumerate(paths):
        b, z, i = names(), names(), names()
        kind = (
            f"CASE WHEN {z}.g <=> {z}.p THEN 'match' WHEN {z}.p IS NULL THEN 'missing' "
            f"WHEN {z}.g IS NULL THEN 'extra' ELSE 'mismatch' END"
        )
        strict = (
            f"CASE WHEN {i} >= size({b}.g) THEN 'fp_extra_pred' WHEN {i} >= size({b}.p) THEN 'fn_missing_pred' "
            f"WHEN {z}.g <=> {z}.p THEN 'match' ELSE 'mismatch' END"
        )
        row = (
            f"named_struct('path_no', {number}, 'path', {quote(label)}, 'slot', {i}, 'gold', {z}.g, "
            f"'pred', {z}.p, 'kind', {kind}, 'strict_kind', {strict})"
        )
        both = (
            f"named_struct('g', {resolve_sql(gold, node, path, names)}, "
            f"'p', {resolve_sql(pred, node, path, names)})"
        )
        per_path.append(bind(both, b, f"transform(arrays_zip({b}.g, {b}.p), ({z}, {i}) -> {row})"))
    return F.expr(f"concat({', '.join(per_path)})")
