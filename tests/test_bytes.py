"""VARIANTs read from their bytes: walks and their sums against plain Python, odd records."""

import json
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginalia import schema as S
from marginalia.functions import variant_bytes as B
from marginalia.functions.variants import projected, schema_valid
from marginalia.operators import chat, export, project as P, rules as R, walk as W
from marginalia.schema import TARGET
from marginalia.session import once

ODD = [
    '{"a":[1.50,"x",null,true,1e5,123456789012345678901234567890,-0.0,1e-7,0.1,-7],"b":{"c":{}},"d":[]}',
    '{"a.b":"k","x[0]":["y",["z"]],"~/":{"razonamiento_1":1},"":"e","fuente":{"fuente":[{"subtitulo":null}]}}',
    json.dumps({f"k{i}": "é" * i for i in range(300)}, ensure_ascii=False),
    json.dumps({"long": "z" * 70_000, "list": list(range(300)), "big": [2**31, -2**40, 10**17]}),
    "[" * 400 + '"deep"' + "]" * 400, '"root"', "null", "[]", None,
]


def frame(spark, texts=ODD):
    return once(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), v=F.try_parse_json("t")).drop("t")


def number(text):
    value = Decimal(text)
    return text if "e" in text else int(value) if value == value.to_integral_value() else str(value.normalize())


def leaves(value, path="", pointer=""):
    """``path, pointer, type, text`` of the leaves, read from parsed JSON."""
    if isinstance(value, dict):
        for k, x in value.items():
            yield from leaves(x, f"{path}.{k}" if path else k, pointer + "/" + k.replace("~", "~0").replace("/", "~1"))
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from leaves(x, f"{path}[{i}]", f"{pointer}/{i}")
    else:
        kind = {str: "string", bool: "boolean", int: "integer", type(None): "null", float: "number"}[type(value)]
        yield path or "<root>", pointer, kind, None if value is None else json.dumps(value) if isinstance(value, bool) else str(value)


def parsed(spark, texts=ODD):
    """The documents as Spark's own JSON has them."""
    return [json.loads(r.j) if r.j else None for r in frame(spark, texts).orderBy("k").select(F.to_json("v").alias("j")).collect()]


def test_bytes_say_what_the_json_text_says(spark):
    rows = frame(spark).orderBy("k").select("v", F.to_json("v").alias("j")).collect()
    for row in rows:
        if row.v is not None:
            read = B.decode(row.v.value, 0, B.keys_of(row.v.metadata))
            assert read == json.loads(row.j, parse_float=B.Number)
    assert rows[-1].v is None


@pytest.mark.parametrize("number, text", [
    (1e5, "100000.0"), (1e7, "1.0E7"), (1.5e-9, "1.5E-9"), (-0.001, "-0.001"), (123456.75, "123456.75"), (1.25e300, "1.25E300"), (0.0, "0.0")])
def test_doubles_are_written_as_java_writes_them(number, text):
    assert B.double_text(number) == text


def test_summed_leaves_are_the_sums_of_the_leaves(spark):
    rows = W.flatten_leaves(frame(spark), "v", []).withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]")).collect()
    want = defaultdict(list)
    for r in rows:
        want[r.path, r.type].append(r.value)
    summed = W.flatten_leaves(frame(spark), "v", [], summed=True).groupBy("path", "type").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    assert {(r.path, r.type): (r.n, r.chars, r.low, r.high) for r in summed} == {
        key: (len(v), sum(len(x or "") for x in v), min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None))
        for key, v in want.items()}
    some = ["a[]", "x[][]", "<root>", "x[]"]
    values = W.flatten_leaves(frame(spark), "v", [], summed=True, paths=some).groupBy("path", "value").agg(F.sum("n").alias("n")).collect()
    assert {(r.path, r.value): r.n for r in values} == Counter((r.path, r.value) for r in rows if r.path in some)


def test_sums_are_given_out_when_many_are_held(spark, monkeypatch):
    texts = [json.dumps({f"k{i}{j}": f"v{i}" for j in range(50)}) for i in range(40)]
    monkeypatch.setattr(W, "HELD_SUMS", 100)
    monkeypatch.setattr(W, "KNOWN_PATTERNS", 100)
    rows = frame(spark, texts).coalesce(1)
    summed = W.flatten_leaves(rows, "v", [], summed=True).collect()
    pointers = W.pointer_leaves(rows, "v", [], summed=True).collect()
    counts = W.node_counts(rows, "v").collect()
    assert sum(r.n for r in summed) == sum(r.n for r in pointers) == 2000
    assert sum(r.n for r in counts) == 2040 and len([r for r in counts if r.pattern == ""]) > 1


def test_pointer_sums_are_the_sums_of_the_leaves(spark):
    want = defaultdict(lambda: [0, 0])
    for r in W.pointer_leaves(frame(spark), "v", []).collect():
        want[r.pointer][0] += 1
        want[r.pointer][1] += len(r.value or "")
    summed = W.pointer_leaves(frame(spark), "v", [], summed=True).groupBy("pointer").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    assert {r.pointer: [r.n, r.chars] for r in summed.collect()} == want


def test_leaves_of_odd_documents(spark):
    plain = [t for t in ODD[1:3] + ODD[4:]]
    want = Counter(leaf for doc, t in zip(parsed(spark, plain), plain) if t is not None for leaf in leaves(doc))
    found = W.walk(frame(spark, plain), "v", [], ("path", "pointer")).where(W.is_leaf())
    path = F.when(F.col("path") == "", "<root>").otherwise(F.col("path"))
    assert Counter(tuple(r) for r in found.select(path, "pointer", "type", "value").collect()) == want


def test_forbidden_keys_at_any_depth_without_json_text(spark):
    found = W.forbidden_paths(frame(spark), "v", ["k"])
    assert {(r.k, r.pointer, r.pattern, r.key) for r in found.collect()} == {
        (1, "/fuente", "/fuente", "fuente"), (1, "/fuente/fuente", "/fuente/fuente", "fuente"),
        (1, "/fuente/fuente/0/subtitulo", "/fuente/fuente/*/subtitulo", "subtitulo"),
        (1, "/~0~1/razonamiento_1", "/~0~1/razonamiento_1", "razonamiento_1")}
    assert "to_json" not in found._jdf.queryExecution().toString()
    flags = frame(spark).select("k", W.has_forbidden(F.col("v")).alias("f")).collect()
    assert {r.k for r in flags if r.f} == {1} and len(flags) == len(ODD)


def test_rule_coverage_and_dropped_keys_count_without_rows_per_node(spark):
    node = S.record(a=S.listing(S.record(b=S.text())), c=S.text())
    rows = frame(spark, ['{"a":[{"b":"x","z":{"q":1}},{"b":1},3],"c":{"d":1},"e":null}', '{"a":{"b":1}}', None])
    assert {r.path: r.nodes for r in R.rule_coverage(rows, "v", node, []).collect()} == {"": 2, "/a": 2, "/a/*": 3, "/a/*/b": 2, "/c": 1}
    dropped = P.dropped_paths(rows, "v", node)
    assert {r.path: r.dropped for r in dropped.collect()} == {"/a/*/z": 1, "/e": 1}
    assert "to_json" not in dropped._jdf.queryExecution().toString()


RULED = S.record(
    t=S.choice("a", "b"), p=S.text(r"^(S/D|\d{2})$"), n=S.whole(1, nullable=True), x=S.Node("number"), c=S.Node("string", const="1"),
    l=S.listing(S.record(k=S.flag()), 1))
BROKEN = [
    ('{"t":"a","p":"12","n":null,"x":1.5,"c":"1","l":[{"k":true}]}', []),
    ('{"t":"c","p":"123","n":0,"x":"1","c":"2","l":[]}', ["c const", "l minItems", "n minimum", "p pattern", "t enum", "x type"]),
    ('{"t":1,"p":"١٢","n":1.5,"x":1,"c":1,"l":[{"k":1},{"z":1},2]}', [
        "c const", "c type", "l/0/k type", "l/1 additionalProperties", "l/1 required", "l/2 type", "n type", "p pattern", "t enum", "t type"]),
    ('{"t":"a","p":"12\\n","l":{}}', ["<root> required", "<root> required", "<root> required", "l type"]),
    ("[]", ["<root> type"]),
]


def test_findings_of_suspects_are_all_findings(spark):
    rows = frame(spark, [t for t, _ in BROKEN])
    found = defaultdict(list)
    for r in R.schema_findings(rows, "v", RULED, ["k"]).collect():
        found[r.k].append(f"{r.path} {r.keyword}")
    assert [sorted(found[k]) for k in range(len(BROKEN))] == [want for _, want in BROKEN]
    for keyword in R.KEYWORDS:
        alone = R.schema_findings(rows, "v", RULED, ["k"], [keyword]).collect()
        assert Counter((r.k, r.path) for r in alone) == Counter(
            (k, f.split()[0]) for k, (_, want) in enumerate(BROKEN) for f in want if f.endswith(" " + keyword))
    # rows that keep their rules for sure do not leave the walk
    assert R._tested(rows, "v", RULED, ["k"], R.KEYWORDS).where("k = 0").count() == 0


def test_validity_detail_counts_what_it_does_not_show(spark):
    items = [{"k": 1} for _ in range(30)] + [{"k": True}]
    record = {"t": "a", "p": "12", "n": 1, "x": 1, "c": "1", "l": items}
    rows = frame(spark, [json.dumps(record), BROKEN[0][0], BROKEN[2][0], None])
    detail = {r.k: r for r in R.validity_detail(rows, "v", RULED, "k", 4).collect()}
    assert (detail[0].error_count, [e.path for e in detail[0].errors]) == (30, ["l/0/k", "l/1/k", "l/2/k", "l/3/k"])
    assert detail[1].valid and detail[1].error_count == 0
    assert (detail[2].error_count, [e.path for e in detail[2].errors]) == (10, ["c", "c", "l/0/k", "l/1"])
    assert not detail[3].valid and detail[3].error_count == 0
    # of thirty broken items those alone leave the walk that are shown
    nodes = R._tested(rows.where("k = 0"), "v", RULED, ["k"], R.KEYWORDS, bare=True, first=4)
    assert nodes.count() == 5 and nodes.agg(F.sum("more")).first()[0] == 26


def test_extra_root_keys_show_without_json_text(spark):
    good = {"t": "a", "p": "12", "n": 1, "c": "1", "l": [{"k": True}]}
    node = S.record(**{k: v for k, v in RULED.props.items() if k != "x"})
    cases = [(good, True), (good | {"z": 1}, False), ({k: v for k, v in good.items() if k != "n"}, False), (good | {"n": None}, True),
             (good | {"l": [{"k": True, "z": 1}]}, False), (good | {"n": "1"}, False), (good | {"l": [{"k": True}, {}]}, False)]
    rows = frame(spark, [json.dumps(c) for c, _ in cases] + [json.dumps(good).replace('"n": 1', '"n": 1.0')])
    found = [r.ok for r in rows.orderBy("k").select(schema_valid("v", node).alias("ok")).collect()]
    assert found == [ok for _, ok in cases] + [True]


def test_projection_of_missing_and_wrong_parts(spark):
    node = S.record(
        s=S.record(a=S.choice("Sí", "No", "S/D"), n=S.whole()), o=S.record(nullable=True, a=S.text()), l=S.listing(S.record(a=S.text(), b=S.listing(S.text()))),
        i=S.record(presencia=S.choice("Sí", "No", "S/D"), valor_booleano=S.flag(nullable=True)), t=S.listing(S.text(), nullable=True))
    empty = {"s": {"a": "S/D", "n": 0}, "o": None, "l": [], "i": {"presencia": "S/D", "valor_booleano": None}, "t": None}
    cases = [
        ({}, empty), ([1], empty), ({"s": None, "o": 5, "l": 7, "i": [], "t": {}}, empty | {"l": 7, "t": {}}),
        ({"s": {"a": " SI ", "n": "x"}, "o": {"z": 1}, "l": [{"a": None, "b": ["y", None, 3], "z": 0}, None, "q"], "i": {"presencia": True}, "t": None},
         {"s": {"a": "Sí", "n": "x"}, "o": {"a": "S/D"}, "l": [{"a": "S/D", "b": ["y", "S/D", 3]}, {"a": "S/D", "b": []}, {"a": "S/D", "b": []}],
          "i": {"presencia": "Sí", "valor_booleano": True}, "t": None}),
    ]
    rows = frame(spark, [json.dumps(c) for c, _ in cases]).select("k", F.to_json(projected("v", node)).alias("p"))
    assert [json.loads(r.p) for r in rows.orderBy("k").collect()] == [want for _, want in cases]
    # each level is taken apart in one cast: a part is not taken out by itself
    assert "$.s" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_the_wide_table_are_read_without_json_text(spark):
    event = {"sujetos": [{"z": 1.50, "sujeto_id": "s", "organizaciones": [{"categoria": True, "organizacion_id": None}]}], "motivos": {}, "accion": {
        "formatos_complementarios": ["a", ["b", 2]]}}
    notes = frame(spark, [json.dumps({"extraccion": {"eventos_protesta": [event, 3]}}), "{}", None])
    flat = export.wide_projection(notes, "v")
    cells = [(r.sujetos, r.motivos, r.accion_formatos_complementarios) for r in flat.collect()]
    empty = ("", "", "")
    assert sorted(cells) == sorted([
        ("sujeto_id=s | organizaciones=organizacion_id= | categoria=true | z=1.5", "", "a ; b ; 2"), empty, empty, empty])
    assert "to_json" not in flat._jdf.queryExecution().toString()


def test_audit_reads_rows_once_and_joins_no_records(spark):
    texts = ["{}", '{"fuente":1}', '{"fuente":2}', '{"a":[{"texto_original":1}]}', None, '{"fuente":3}']
    rows = frame(spark, texts).withColumns({
        "key": F.expr("CASE WHEN k < 3 THEN 'a' WHEN k < 5 THEN 'b' END"), "split": F.when(F.col("k") != 5, "train"), "user": F.when(F.col("k") != 3, "x")})
    want = {"train": (5, 4, 1, 5 - 1, 1), None: (1, 1, 0, 1, 0)}
    for found in (chat.chat_findings(rows, "v", "user"), chat.chat_findings(chat.record_findings(rows, "v").drop("v"), "v", "user")):
        audit = chat.chat_audit(found, "v", "key")
        assert {r.split: (r.rows, r.written, r.missing_user_messages, r.assistant_schema_invalid, r.assistant_forbidden_paths) for r in audit.collect()} == want


def test_row_errors_keep_records_only_where_they_are_walked(spark):
    node = {"schema_version": "1.0.0", "nota": {"nota_id": "n", "fecha_publicacion": "S/D", "titulo": "t"},
            "extraccion": {"tiene_eventos_protesta": False, "total_eventos_protesta": 1, "eventos_protesta": []}}
    bad = json.loads(json.dumps(node))
    bad["nota"]["fecha_publicacion"] = "1990-01-05"
    errors = P.row_errors(P.judge(frame(spark, [json.dumps(node), json.dumps(bad)]), "v"), "v", "k")
    found = defaultdict(list)
    for r in errors.orderBy("k", "rank").collect():
        found[r.k].append(r.error.split(" ")[0])
    assert [len(found[0]), len(found[1])] == [2, 3] and found[1][-1] == "nota/fecha_publicacion:"
    assert TARGET.props["nota"].props["fecha_publicacion"].pattern
