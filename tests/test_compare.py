"""Leaf comparison: the general join on fixed cases, the typed expression against it."""

import json

from pyspark.sql import functions as F

from marginalia.functions.compare import leaf_f1_counts, leaf_recall_counts
from marginalia.functions.paths import path_counts, slot_pairs
from marginalia.operators.leafjoin import leaf_counts, leaf_pairs
from marginalia.schema import choice, ddl, flag, listing, record, text, whole

# gold, pred, (tp, fp, fn)
F1_CASES = [
    ('{"a":1,"b":"x"}', '{"a":1,"b":"x"}', (2, 0, 0)),
    ('{"a":1}', '{"a":2}', (0, 1, 1)),
    ('{"a":null}', '{"a":{"b":1,"c":2}}', (0, 2, 0)),
    ('{"a":{"b":1}}', '{"a":null}', (0, 0, 1)),
    ('{"a":null}', '{"a":[]}', (0, 0, 0)),
    ('{"a":[1,2]}', '{"a":[1]}', (1, 0, 1)),
    ('{"a":[{"x":1}]}', '{"a":[{"x":1},{"x":null}]}', (1, 1, 0)),
    ('{"a":[null]}', '{"a":[3]}', (0, 1, 0)),
    ("{}", '{"a":null}', (0, 1, 0)),
    ('{"a":null}', '{"a":null}', (1, 0, 0)),
    ('{"a":[null]}', '{"a":[]}', (1, 0, 0)),
    ('{"a":{"b":1}}', '{"a":[1,2]}', (0, 2, 0)),
    ('{"a":[[null]]}', '{"a":[]}', (0, 0, 1)),
]
# gold, pred, (gold_leaves, exact_match, non_empty_recovery, null_or_empty_in_gold)
RECALL_CASES = [
    ('{"a":"x"}', '{"a":"y"}', (1, 0, 1, 0)),
    ('{"a":""}', '{"a":"y"}', (1, 0, 0, 1)),
    ('{"a":[1]}', '{"a":[1,2]}', (2, 1, 1, 1)),
    ('{"a":{"b":1}}', '{"a":null}', (1, 0, 0, 0)),
    ("{}", '{"a":1}', (0, 0, 0, 0)),
]
SMALL = record(
    name=text(),
    sure=flag(),
    detail=record(nullable=True, kind=choice("a", "b"), n=whole(nullable=True)),
    items=listing(record(tag=text(), refs=listing(text(), 1), at=record(nullable=True, x=text())), 1, nullable=True),
)


def variants(spark, cases):
    rows = [(i, g, p) for i, (g, p, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, g string, p string")
    return df.select("k", F.try_parse_json("g").alias("gv"), F.try_parse_json("p").alias("pv"))


def general(df):
    return {r.k: r for r in leaf_counts(leaf_pairs(df, "gv", df, "pv", "k"), "k").collect()}


def test_records_inside_a_clash_take_no_part(spark):
    """Only what lies below the clashing record goes: a key that begins alike, lists and other notes stay."""
    cases = [
        ({"a": {"x": 1, "y": [1, {"z": 2}]}, "a-b": 1, "ab": {"x": 3}}, {"a": [7, {"x": 8}], "a-b": 1, "ab": {"x": 3}}),
        ({"x": 1, "y": {"z": 2}}, [1, {"x": 2}]),
        ([1], {"q": {"r": 1}}),
        ({"l": [{"m": {"n": 1}}, {"m": [1]}], "k": 1}, {"l": [{"m": [2]}, {"m": {"n": 2}}], "k": 1}),
    ]
    df = variants(spark, [(json.dumps(g), json.dumps(p), None) for g, p in cases])
    kept = {}
    for r in leaf_pairs(df, "gv", df, "pv", "k").where("gold_type NOT IN ('object', 'array') OR pred_type NOT IN ('object', 'array')").collect():
        kept.setdefault(r.k, set()).add(r.path)
    assert kept == {0: {"a[0]", "a[1].x", "a-b", "ab.x"}, 1: {"[0]", "[1].x"}, 2: {"[0]"}, 3: {"l[0].m[0]", "l[1].m[0]", "k"}}


def test_a_large_note_with_many_clashes(spark):
    gold = {f"k{i}": {"x": i, "y": i} if i % 10 == 0 else i for i in range(20_000)}
    pred = {f"k{i}": [i] if i % 10 == 0 else i for i in range(20_000)}
    counts = general(variants(spark, [(json.dumps(gold), json.dumps(pred), None)]))[0]
    assert (counts.tp, counts.fp, counts.fn) == (18_000, 2_000, 0)


def test_general_f1_cases(spark):
    found = general(variants(spark, F1_CASES))
    for i, (gold, pred, expected) in enumerate(F1_CASES):
        assert (found[i].tp, found[i].fp, found[i].fn) == expected, (gold, pred)


def test_general_recall_cases(spark):
    found = general(variants(spark, RECALL_CASES))
    for i, (gold, pred, expected) in enumerate(RECALL_CASES):
        r = found[i]
        assert (r.gold_leaves, r.exact_match, r.non_empty_recovery, r.null_or_empty_in_gold) == expected, (gold, pred)


def records():
    detail = [None, {"kind": "a", "n": 1}, {"kind": "b", "n": None}]
    item = [
        {"tag": "t", "refs": ["r"], "at": None},
        {"tag": "", "refs": ["r", "s"], "at": {"x": "1"}},
        {"tag": "u", "refs": ["q"], "at": {"x": ""}},
    ]
    lists = [None, item[:1], item[1:], item, item[::-1]]
    return [
        {"name": n, "sure": s, "detail": d, "items": li}
        for n, s in (("x", True), ("", False)) for d in detail for li in lists
    ]


def test_typed_expression_equals_general_join(spark):
    found = records()
    cases = [(json.dumps(g), json.dumps(p), None) for g in found[::2] for p in found]
    df = variants(spark, cases)
    typed = df.select("k", *[F.expr(f"try_variant_get({c}v, '$', '{ddl(SMALL)}')").alias(c) for c in "gp"])
    mine = typed.select("k", leaf_f1_counts("g", "p", SMALL).alias("f"), leaf_recall_counts("g", "p", SMALL).alias("r")).collect()
    reference = general(df)
    for row in mine:
        other = reference[row.k]
        assert (row.f.tp, row.f.fp, row.f.fn) == (other.tp, other.fp, other.fn), cases[row.k]
        assert tuple(row.r) == (
            other.gold_leaves, other.exact_match, other.non_empty_recovery, other.null_or_empty_in_gold
        ), cases[row.k]
        assert row.f.gold_leaves == row.f.tp + row.f.fn and row.f.pred_leaves == row.f.tp + row.f.fp


def test_equal_sides_and_swapped_sides(spark):
    found = [json.dumps(r) for r in records()]
    pairs = [(a, b, None) for a, b in zip(found, reversed(found))]
    df = variants(spark, pairs)
    typed = df.select("k", *[F.expr(f"try_variant_get({c}v, '$', '{ddl(SMALL)}')").alias(c) for c in "gp"])
    for row in typed.select(
        leaf_f1_counts("g", "g", SMALL).alias("same"), leaf_f1_counts("g", "p", SMALL).alias("one"),
        leaf_f1_counts("p", "g", SMALL).alias("two"),
    ).collect():
        assert row.same.fp == row.same.fn == 0 and row.same.tp > 0
        assert (row.one.tp, row.one.fp, row.one.fn) == (row.two.tp, row.two.fn, row.two.fp)


def test_path_counts_and_slot_kinds(spark):
    gold = {"name": "x", "sure": False, "detail": {"kind": "a", "n": None}, "items": [{"tag": "t", "refs": ["r", "s"], "at": None}]}
    pred = {"name": "y", "sure": False, "detail": None, "items": [{"tag": "t", "refs": ["r"], "at": None}, {"tag": "z", "refs": ["q"], "at": None}]}
    df = variants(spark, [(json.dumps(gold), json.dumps(pred), None)])
    typed = df.select(*[F.expr(f"try_variant_get({c}v, '$', '{ddl(SMALL)}')").alias(c) for c in "gp"])
    paths = [("name", "name"), ("sure", "sure"), ("kind", "detail.kind"), ("n", "detail.n"), ("tag", "items[].tag"), ("refs", "items[].refs[]")]
    counts = {r.path: (r.tp, r.tn, r.fp, r.fn) for r in typed.select(F.inline(path_counts("g", "p", SMALL, paths))).collect()}
    assert counts == {
        "name": (0, 0, 1, 1), "sure": (0, 1, 0, 0), "kind": (0, 0, 0, 1), "n": (0, 0, 0, 0), "tag": (1, 0, 1, 0), "refs": (1, 0, 1, 1),
    }
    slots = typed.select(F.inline(slot_pairs("g", "p", SMALL, paths))).collect()
    kinds = {(r.path, r.slot): (r.kind, r.strict_kind) for r in slots}
    assert kinds[("n", 0)] == ("match", "fn_missing_pred")
    assert kinds[("kind", 0)] == ("missing", "fn_missing_pred")
    assert kinds[("tag", 1)] == ("extra", "fp_extra_pred")
    # values align in the flattened list: the second reference meets the next item's first
    assert kinds[("refs", 1)] == ("mismatch", "mismatch")


def test_records_are_shuffled_not_their_paths(spark):
    rows = spark.createDataFrame([("n", '{"a":[1,2]}', '{"a":[1]}')], "k string, g string, p string")
    both = rows.select("k", F.try_parse_json("g").alias("g"), F.try_parse_json("p").alias("p"))
    plan = leaf_pairs(both, "g", both, "p", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_records_of_a_repeated_key_all_meet(spark):
    rows = spark.createDataFrame([("n", '{"a":1}', '{"a":1}'), ("n", '{"a":2}', None), (None, '{"a":1}', '{"a":1}')], "k string, g string, p string")
    both = rows.select("k", F.try_parse_json("g").alias("g"), F.try_parse_json("p").alias("p"))
    found = [(r.k, r.path, r.gold_value, r.pred_value) for r in leaf_pairs(both, "g", both, "p", "k").where("path = 'a'").collect()]
    assert sorted(found, key=str) == sorted(2 * [("n", "a", "1", "1"), ("n", "a", "2", "1")] + [(None, "a", "1", None), (None, "a", None, "1")], key=str)
