"""Expressions over VARIANT values: JSON types, validity, projection."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, functions as F

from marginalia.functions.sqltext import Names, bind, quote
from marginalia.schema import SD, YES_NO_SD, Node, ddl

NULL_VARIANT = "parse_json('null')"


def is_object(v: str) -> str:
    """Casting to a one-field struct succeeds for any object and copies none of it."""
    return f"(try_variant_get({v}, '$', 'struct<_:boolean>') IS NOT NULL)"


def items(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def entries(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def member(v: str, key: str) -> str:
    """Value of one key: SQL NULL if the key is absent, a null variant if it is JSON null."""
    return f"try_variant_get({v}, {quote('$.' + key)}, 'variant')"


def as_text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def scalar_type(v: str) -> str:
    """JSON type of a scalar; a number without fraction is an integer."""
    number = f"try_variant_get({v}, '$', 'double')"
    known = "map('STRING', 'string', 'VOID', 'null', 'BOOLEAN', 'boolean', 'BIGINT', 'integer')"
    return (
        f"coalesce(try_element_at({known}, schema_of_variant({v})), "
        f"CASE WHEN {number} = floor({number}) THEN 'integer' ELSE 'number' END)"
    )


def json_type(v: str) -> str:
    return (
        f"CASE WHEN {is_object(v)} THEN 'object' WHEN {items(v)} IS NOT NULL THEN 'array' "
        f"ELSE {scalar_type(v)} END"
    )


# --- validity against a schema ------------------------------------------------------


def _value_rules(value: str, node: Node, names: Names) -> list[str]:
    """Conditions on a typed value beyond its type; none if nothing can break."""
    rules: list[str] = []
    if node.enum:
        rules.append(f"{value} IN ({', '.join(quote(e) for e in node.enum)})")
    if node.const is not None:
        rules.append(f"{value} = {quote(node.const)}")
    if node.pattern:
        rules.append(f"{value} RLIKE {quote(node.pattern)}")
    if node.minimum is not None:
        rules.append(f"{value} >= {node.minimum}")
    if node.min_items:
        rules.append(f"size({value}) >= {node.min_items}")
    for key, child in node.props.items():
        rules += _value_rules(f"{value}.{key}", child, names)
    if node.item is not None:
        x = names()
        below = _value_rules(x, node.item, names)
        if below:
            rules.append(f"forall({value}, {x} -> {' AND '.join(below)})")
    if not rules and not node.nullable:
        return [f"{value} IS NOT NULL"]
    if not rules:
        return []
    together = "(" + " AND ".join(rules) + ")"
    return [f"({value} IS NULL OR {together})"] if node.nullable else [f"{value} IS NOT NULL", together]


def _fully_closed(node: Node) -> bool:
    inner = list(node.props.values()) + ([node.item] if node.item else [])
    own = node.kind != "object" or (node.closed and set(node.required) == set(node.props))
    return own and all(_fully_closed(c) for c in inner)


SHAPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT"}


def _shape(node: Node) -> str:
    """Regular expression of the types ``schema_of_variant`` names for a complete value; none fits a kind without a fixed type."""
    if node.kind == "object":
        shape = "OBJECT<" + ", ".join(f"{re.escape(k)}: {_shape(c)}" for k, c in sorted(node.props.items())) + ">"
    elif node.kind == "array":
        shape = f"ARRAY<({_shape(node.item)}|VOID)>"
    else:
        shape = SHAPES.get(node.kind, "(?!)")
    return f"({shape}|VOID)" if node.nullable else shape


PLAIN_KEY = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def _keyed(node: Node) -> str | None:
    """As ``_shape``, with the right keys but scalars of any type; None if a key may be written in quotes.

    A record that this does not fit has other keys than the schema, whatever its values.
    """
    if node.kind == "object":
        parts = [(k, _keyed(c)) for k, c in sorted(node.props.items())]
        if any(part is None or not PLAIN_KEY.fullmatch(k) for k, part in parts):
            return None
        shape = "OBJECT<" + ", ".join(f"{k}: {part}" for k, part in parts) + ">"
    elif node.kind == "array":
        item = _keyed(node.item)
        if item is None:
            return None
        shape = f"ARRAY<{item}>"
    else:
        shape = r"[A-Z_]+(\([0-9, ]+\))?"
    return f"({shape}|VOID|VARIANT)"


def _any_nullable(node: Node) -> bool:
    inner = list(node.props.values()) + ([node.item] if node.item else [])
    return node.nullable or any(_any_nullable(c) for c in inner)


def _keys_there(v: str, path: str, t: str, node: Node, names: Names) -> list[str]:
    """Conditions that every nullable key below ``path`` in the VARIANT ``v`` is there, ``t`` being the typed value.

    Only a key whose typed value is null can be missing; one that must not be null fails the
    value rules then, so nullable keys alone are looked up.
    """
    if node.kind == "array":
        if not _any_nullable(node.item):
            return []
        x, y, ok = names(), names(), names()
        below = " AND ".join(_keys_there(x, "$", y, node.item, names)) or "true"
        found = f"try_variant_get({v}, {quote(path)}, 'array<variant>')"
        return [f"forall(zip_with({found}, {t}, ({x}, {y}) -> {y} IS NULL OR ({below})), {ok} -> {ok})"]
    tests = []
    for key, child in node.props.items():
        below = _keys_there(v, f"{path}.{key}", f"{t}.{key}", child, names)
        if child.nullable:
            there = f"try_variant_get({v}, {quote(f'{path}.{key}')}, 'variant') IS NOT NULL"
            tests.append(f"CASE WHEN {t}.{key} IS NULL THEN {there} ELSE {' AND '.join(below) or 'true'} END")
        else:
            tests += below
    return tests


def _complete(v: str, t: str, node: Node) -> str:
    """Whether every record in ``v`` has just the schema's keys, with values of their types; ``t`` is the typed record.

    The types of list items are named together, which hides a key that only some of them
    lack, so missing keys are looked for beside.
    """
    tests = [f"schema_of_variant({v}) RLIKE {quote(f'^{_shape(node)}$')}", *_keys_there(v, "$", t, node, Names("u"))]
    return "(" + " AND ".join(tests) + ")"


def _checked(value: str, node: Node, result: str) -> Column:
    """``result`` over the typed record ``t`` where the VARIANT satisfies the schema, else null; typed once."""
    if not _fully_closed(node):
        raise ValueError("needs closed records with all keys required")
    typed = f"try_variant_get({value}, '$', {quote(ddl(node))})"
    values = " AND ".join(_value_rules("t", node, Names("w")))
    same_text, keyed = f"to_json(to_variant_object(t)) = to_json({value})", _keyed(node)
    if keyed:
        same_text = f"(schema_of_variant({value}) RLIKE {quote(f'^{keyed}$')} AND {same_text})"
    found = bind(typed, "t", f"CASE WHEN ({values}) AND ({_complete(value, 't', node)} OR {same_text}) THEN {result} END")
    if node.kind == "object":
        # most records outside the schema have other keys at their root, which shows without a cast of the whole
        found = f"CASE WHEN size(try_variant_get({value}, '$', 'map<string,boolean>')) = {len(node.props)} THEN {found} END"
    return F.expr(found)


def valid_record(value: str, node: Node) -> Column:
    """The typed record of a VARIANT column that satisfies the schema, else null: ``schema_valid`` and the cast in one."""
    return _checked(value, node, "t")


def read_record(text: str, node: Node) -> Column:
    """The typed record of a JSON text that satisfies the schema, without the VARIANT in between, which costs as much again.

    A text that cannot be read straight, as with a value of another type or without a root
    key, is cast from its VARIANT. Keys are not checked for copies: of those the last counts.
    """
    bad = "__unread"
    read = f"from_json({text}, {quote(ddl(node)[:-1] + f', {bad}: STRING>')}, map('columnNameOfCorruptRecord', '{bad}'))"
    smooth = " AND ".join([f"r.{bad} IS NULL"] + [f"r.{key} IS NOT NULL" for key in node.props])
    record = ", ".join(f"{quote(key)}, r.{key}" for key in node.props)
    other = f"try_variant_get(try_parse_json({text}), '$', {quote(ddl(node))})"
    return F.expr(bind(read, "r", f"CASE WHEN {smooth} THEN named_struct({record}) ELSE {other} END"))


def schema_valid(value: str, node: Node) -> Column:
    """Whether a VARIANT column satisfies the schema; false for SQL NULL.

    One expression per row. Casting to the schema's type and back must lose nothing: extra
    keys, missing keys and values of another type all change the text of the round trip.
    That text is written only where the keys are right and the types alone do not show it, as for
    ``1.0`` in the place of an integer. Then the value rules are tested on the typed record. Needs closed records
    whose keys are all required. ``marginalia.operators.rules`` lists the single findings.
    """
    return F.coalesce(_checked(value, node, "true"), F.lit(False))


def _null_member(node: Node) -> bool:
    """Whether null is allowed somewhere by type but not by an enum or a const."""
    inner = list(node.props.values()) + ([node.item] if node.item else [])
    return (node.nullable and (bool(node.enum) or node.const is not None)) or any(_null_member(c) for c in inner)


def _first_problem(v: str, node: Node, names: Names, at: str, passed: bool = False) -> str:
    """SQL of the first broken rule of a present value, or null.

    Listing the rules takes every part out of its VARIANT. A closed record or list is therefore typed
    whole first, and its rules are listed only where that does not show that it keeps them all.
    """
    closed = node.is_container and _fully_closed(node) and not _null_member(node)
    listed = f"coalesce({', '.join(_problems(v, node, names, at, passed or closed))})"
    if passed or not closed:
        return listed
    t = names()
    kept = " AND ".join([*_value_rules(t, node, names), _complete(v, t, node)])
    return bind(f"try_variant_get({v}, '$', {quote(ddl(node))})", t, f"CASE WHEN {t} IS NOT NULL AND {kept} THEN NULL ELSE {listed} END")


def _problems(v: str, node: Node, names: Names, at: str, passed: bool) -> list[str]:
    """SQL texts that name a broken rule of a present value, or are null; own rules before those below.

    ``passed``: a closed value around it has been typed already.
    """
    said = lambda keyword, where=at: quote(f"{keyword} at {where or '/'}")
    kind, text, number = names(), as_text(v), f"try_variant_get({v}, '$', 'double')"
    allowed = [node.kind] + ["integer"] * (node.kind == "number") + ["null"] * node.nullable
    tests = [(f"{kind} NOT IN ({', '.join(map(quote, allowed))})", "type")]
    if node.enum:
        tests.append((f"{kind} <> 'string' OR {text} NOT IN ({', '.join(map(quote, node.enum))})", "enum"))
    if node.const is not None:
        tests.append((f"{kind} <> 'string' OR {text} <> {quote(node.const)}", "const"))
    if node.pattern:
        tests.append((f"{kind} = 'string' AND NOT {text} RLIKE {quote(node.pattern)}", "pattern"))
    if node.minimum is not None:
        tests.append((f"{kind} IN ('integer', 'number') AND {number} < {node.minimum}", "minimum"))
    if node.min_items:
        tests.append((f"{kind} = 'array' AND size({items(v)}) < {node.min_items}", "minItems"))
    for key in node.required:
        tests.append((f"{kind} = 'object' AND {member(v, key)} IS NULL", f"required {key}"))
    if node.closed:
        known = f"array({', '.join(map(quote, node.props))})" if node.props else "CAST(array() AS ARRAY<STRING>)"
        tests.append((f"{kind} = 'object' AND size(array_except(map_keys({entries(v)}), {known})) > 0", "additionalProperties"))
    own = "CASE " + " ".join(f"WHEN {test} THEN {said(keyword)}" for test, keyword in tests) + " END"
    below = []
    for key, child in node.props.items():
        c = names()
        inner = _first_problem(c, child, names, f"{at}/{key}", passed)
        below.append(bind(member(v, key), c, f"CASE WHEN {c} IS NOT NULL THEN {inner} END"))
    if node.item is not None:
        x = names()
        inner = _first_problem(x, node.item, names, f"{at}/*", passed)
        below.append(f"get(array_compact(transform({items(v)}, {x} -> {inner})), 0)")
    return [bind(json_type(v), kind, own), *below]


def schema_problem(value: str, node: Node) -> Column:
    """The first broken rule of a VARIANT column, as ``keyword at /path``, or null if it satisfies the schema.

    Unlike ``schema_valid`` this takes open schemas: keys without a rule may be there, and a
    declared key may be missing where it is not required. A value's own rules come before those
    of its parts, keys in declared order, list items in list order. SQL NULL breaks the type.
    """
    found = _first_problem(value, node, Names("q"), "")
    return F.expr(f"CASE WHEN {value} IS NULL THEN 'type at /' ELSE {found} END")


# --- projection onto a schema -------------------------------------------------------


def default_value(node: Node) -> Any:
    """Value of a missing key."""
    if node.const is not None:
        return node.const
    if SD in node.enum:
        return SD
    if node.nullable:
        return None
    if node.kind == "object":
        return {k: default_value(c) for k, c in node.props.items()}
    return {"array": [], "string": SD, "integer": 0, "boolean": False}.get(node.kind)


def _literal(value: Any) -> str:
    return f"parse_json({quote(json.dumps(value, ensure_ascii=False))})"


def member_like(value: str, members: tuple[str, ...]) -> str:
    """The member equal to a text up to case, accents and amount of white space, or NULL."""
    listed = ", ".join(quote(m) for m in members)
    squeezed = f"trim(regexp_replace({value}, '\\\\s+', ' '))"
    return f"get(filter(array({listed}), e -> collate(e, 'UNICODE_CI_AI') = {squeezed}), 0)"


def _coerced(v: str, node: Node) -> str:
    kind = f"schema_of_variant({v})"
    unknown = f"CAST({quote(SD)} AS VARIANT)"
    if node.enum:
        known = ", ".join(quote(e) for e in node.enum)
        fallback = unknown if SD in node.enum else v
        when_bool = ""
        if set(node.enum) == set(YES_NO_SD):
            yes = f"CASE WHEN try_variant_get({v}, '$', 'boolean') THEN 'Sí' ELSE 'No' END"
            when_bool = f"WHEN {kind} = 'BOOLEAN' THEN CAST({yes} AS VARIANT) "
        # most values are members, which shows without their type unless a member could be written for another type
        plain = all(re.match("[^\\W\\d]", e) and e.lower() not in ("true", "false", "nan", "infinity") for e in node.enum)
        first = f"WHEN {as_text(v)} IN ({known}) THEN {v} " if plain else ""
        return (
            f"CASE {first}WHEN {kind} = 'STRING' THEN CASE WHEN {as_text(v)} IN ({known}) THEN {v} "
            f"ELSE coalesce(CAST({member_like(as_text(v), node.enum)} AS VARIANT), {fallback}) END "
            f"{when_bool}WHEN is_variant_null({v}) THEN {fallback} ELSE {v} END"
        )
    if node.kind == "string":
        return f"CASE WHEN is_variant_null({v}) THEN {unknown} ELSE {v} END"
    return v


def _nests(key: str, node: Node, above: Node) -> bool:
    """Whether a part is taken apart together with the record around it; an indicator's ``presencia`` is looked at as it is."""
    indicator = key == "presencia" and "valor_booleano" in above.props
    return node.kind == "object" and node.const is None and not node.enum and not indicator


def _ticked(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


def _listed(node: Node) -> bool:
    """Whether an array holds records that are taken apart with it."""
    return node.kind == "array" and node.const is None and not node.enum and _nests("", node.item, node)


def _taken(node: Node, lists: bool = False) -> str:
    """Type that takes a record apart in one cast: records below it as records, with ``lists`` lists of records too, all else as VARIANT.

    A VARIANT cast out of another is built anew, so what lies at one level is not taken out part by part.
    """
    def kind(key: str, sub: Node) -> str:
        if _nests(key, sub, node):
            return _taken(sub, lists)
        return f"array<{_taken(sub.item)}>" if lists and _listed(sub) else "variant"

    return f"struct<{', '.join(f'{_ticked(key)}: {kind(key, sub)}' for key, sub in node.props.items()) or '_: boolean'}>"


def _list_paths(node: Node) -> list[tuple[str, ...]]:
    """Keys that lead to the lists of records that ``_taken`` takes apart."""
    found = [(key,) for key, sub in node.props.items() if _listed(sub)]
    return found + [(key, *path) for key, sub in node.props.items() if _nests(key, sub, node) for path in _list_paths(sub)]


Blank = dict[str, tuple[str, tuple[str, ...]]]


def _fields(s: str, node: Node, names: Names, blank: Blank, at: str, lists: bool = False) -> str:
    """The projected struct of a record ``s`` of type ``_taken``; a null ``s`` gives the defaults."""

    def child(key: str) -> str:
        sub, found, below = node.props[key], f"{s}.{_ticked(key)}", f"{at}/{key}"
        if sub.const is not None:
            return f"CAST({quote(sub.const)} AS VARIANT)"
        if _nests(key, sub, node):
            return _record(found, sub, names, blank, below, lists)
        if lists and _listed(sub):
            x = names()
            missing = "" if sub.nullable else " ELSE array()"
            return f"CASE WHEN {found} IS NOT NULL THEN transform({found}, {x} -> {_record(x, sub.item, names, blank, f'{below}/*')}){missing} END"
        missing = _literal(default_value(sub))
        if not sub.is_container and not sub.enum and sub.kind != "string":
            return f"coalesce({found}, {missing})"
        inner = _projected(found, sub, names, blank, below)
        return f"CASE WHEN {found} IS NULL THEN {missing} ELSE {inner} END"

    fields = {key: child(key) for key in node.props}
    if {"presencia", "valor_booleano"} <= set(node.props):
        source = f"{s}.{_ticked('presencia')}"
        fields["valor_booleano"] = (
            f"CASE WHEN schema_of_variant({source}) = 'BOOLEAN' THEN {source} ELSE {fields['valor_booleano']} END"
        )
    flag_name, kept = blank.get(at, (None, ()))
    if not flag_name:
        return "named_struct(" + ", ".join(f"{quote(k)}, {e}" for k, e in fields.items()) + ")"
    off = names()
    body = ", ".join(f"{quote(k)}, " + (e if k in kept else f"CASE WHEN NOT {off} THEN {e} END") for k, e in fields.items())
    is_off = f"coalesce(try_variant_get({fields[flag_name]}, '$', 'boolean') = false, false)"
    return bind(is_off, off, f"named_struct({body})")


def _record(s: str, node: Node, names: Names, blank: Blank, at: str, lists: bool = False) -> str:
    """``_fields`` of a record that may be missing: null or, where that is not allowed, its default."""
    record = _fields(s, node, names, blank, at, lists)
    if node.nullable:
        return f"CASE WHEN {s} IS NOT NULL THEN {record} END"
    if any(rule.startswith(f"{at}/") or rule == at for rule in blank):
        # in a default no flag makes anything null
        return f"CASE WHEN {s} IS NOT NULL THEN {record} ELSE {_fields(s, node, names, {}, at, lists)} END"
    return record


def _projected(v: str, node: Node, names: Names, blank: Blank, at: str) -> str:
    """The projected VARIANT of a VARIANT that is not null."""
    if node.const is not None:
        return f"CAST({quote(node.const)} AS VARIANT)"
    if node.kind == "array":
        a, x, item = names(), names(), node.item
        if _nests("", item, node):
            found, inner = f"try_variant_get({v}, '$', {quote(f'array<{_taken(item)}>')})", _record(x, item, names, blank, f"{at}/*")
        else:
            found, inner = items(v), _projected(x, item, names, blank, f"{at}/*")
        return bind(found, a, f"CASE WHEN {a} IS NULL THEN {v} ELSE to_variant_object(transform({a}, {x} -> {inner})) END")
    if node.kind != "object":
        return _coerced(v, node)
    s, paths = names(), _list_paths(node)
    record = f"to_variant_object({_fields(s, node, names, blank, at)})"
    whole = bind(f"try_variant_get({v}, '$', {quote(_taken(node))})", s, f"CASE WHEN {s} IS NOT NULL THEN {record} ELSE {_literal(default_value(node))} END")
    if not paths or not all(PLAIN_KEY.fullmatch(key) for path in paths for key in path):
        return whole
    # most records have a list wherever one is due, so that the lists are taken apart and built together with the record
    r = names()
    fits = " AND ".join(
        f"({r}.{'.'.join(map(_ticked, path))} IS NOT NULL OR try_variant_get({v}, {quote('$.' + '.'.join(path))}, 'variant') IS NULL)" for path in paths)
    fitting = f"CASE WHEN {r} IS NOT NULL AND {fits} THEN to_variant_object({_fields(r, node, names, blank, at, True)}) END"
    return f"coalesce({bind(f'try_variant_get({v}, {chr(39)}${chr(39)}, {quote(_taken(node, True))})', r, fitting)}, {whole})"


def projected(
    value: str, node: Node, blank_when_false: dict[str, tuple[str, tuple[str, ...]]] | None = None
) -> Column:
    """A VARIANT holding only the schema's keys.

    Missing keys get defaults, enum texts are matched without case and accents, and a
    record where none is expected becomes its default. A value of a wrong type that
    cannot be coerced stays as it is, for the validation after it to report.
    ``blank_when_false`` maps a record pointer to ``(flag, kept keys)``: where the
    projected flag is false, all other keys become null.
    """
    whole = _projected(value, node, Names("p"), blank_when_false or {}, "")
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN {whole} END")
