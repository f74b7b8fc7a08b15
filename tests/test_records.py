"""Walk, schema findings, null contract, projection and the flat export."""

import json
import re

import pytest
from pyspark.sql import functions as F

from marginalia import schema as S
from marginalia.functions import render, text as X
from marginalia.functions.variants import default_value, schema_valid
from marginalia.operators import contract, export, project as P, rules as R, walk as W
from marginalia.schema import TARGET, from_json_schema, record, required_paths, text, walk_schema


def frame(spark, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "k int, j string").select("k", F.try_parse_json("j").alias("v"))


def event(**changes):
    full = default_value(TARGET.props["extraccion"].props["eventos_protesta"].item)
    return {**full, "evento_id": "e", "evento_numero": 1, **changes}


def note(*events, **changes):
    body = {"tiene_eventos_protesta": bool(events), "total_eventos_protesta": len(events), "eventos_protesta": list(events)}
    return {"schema_version": "1.0.0", "nota": {"nota_id": "n", "fecha_publicacion": "S/D", "titulo": "t"}, "extraccion": {**body, **changes}}


def test_target_schema_has_92_required_paths():
    assert len(required_paths(TARGET)) == 92


def test_schema_document_round_trip():
    doc = {
        "type": "object", "additionalProperties": False, "required": ["a", "b"],
        "properties": {"a": {"$ref": "#/$defs/A"}, "b": {"type": ["array", "null"], "minItems": 1, "items": {"type": "integer", "minimum": 0}}},
        "$defs": {"A": {"type": "string", "enum": ["x", "S/D"]}},
    }
    node = from_json_schema(doc)
    assert node.props["a"].enum == ("x", "S/D") and node.props["b"].nullable and node.props["b"].item.minimum == 0
    assert [p for p, _ in walk_schema(node)] == ["", "/a", "/b", "/b/*"]


def test_walk_paths_and_pointers(spark):
    df = frame(spark, {"a/b": {"c~": [1, {"d": None}]}, "e": [], "f": {}}, "5")
    rows = {r.pointer: (r.path, r.pattern, r.type) for r in W.walk(df, "v", ["k"]).where("k = 0").collect()}
    assert rows["/a~1b/c~0/1/d"] == ("a/b.c~[1].d", "/a~1b/c~0/*/d", "null")
    assert rows["/e"][2] == "array" and rows["/f"][2] == "object"
    leaves = W.flatten_leaves(df, "v", ["k"]).collect()
    assert {(r.k, r.path, r.value) for r in leaves} == {(0, "a/b.c~[0]", "1"), (0, "a/b.c~[1].d", None), (1, "<root>", "5")}


@pytest.mark.parametrize("levels", [40, 900])
def test_walk_goes_to_any_depth(spark, levels):
    deep = "x"
    for k in range(levels):
        deep = {"a": deep} if k % 2 else [deep]
    df = frame(spark, deep)
    nodes = W.walk(df, "v", ["k"]).collect()
    assert len(nodes) == levels + 1
    leaf = W.pointer_leaves(df, "v", ["k"]).collect()
    assert [(r.type, r.value, r.pointer) for r in leaf] == [("string", "x", "/a/0" * (levels // 2))]
    assert W.flatten_leaves(df, "v", ["k"]).first().path == ".".join(["a[0]"] * (levels // 2))


def test_walk_of_values_keeps_types_and_texts(spark):
    doc = {"i": 1234567890123456789, "d": 1.50, "w": 2.0, "e": 1e300, "t": True, "n": None, "s": "q\"u\\o\nte", "": {"": []}, "u": "ñ/~"}
    found = {r.pointer: r for r in W.walk(frame(spark, doc), "v", []).collect()}
    assert {p: (found[p].type, found[p].value) for p in ("/i", "/t", "/n", "/s", "/u")} == {
        "/i": ("integer", "1234567890123456789"), "/t": ("boolean", "true"), "/n": ("null", None), "/s": ("string", doc["s"]), "/u": ("string", "ñ/~")}
    assert found["/d"].type == "number" and float(found["/d"].value) == 1.5 and found["/w"].type == "integer" and found["/e"].type == "integer"
    assert found["//"].type == "array" and found["/"].keys == [""] and found["//"].size == 0
    wanted = W.walk(frame(spark, doc), "v", [], ("pointer",), patterns=["/s", "/none"]).collect()
    assert [r.pointer for r in wanted] == ["/s"]


def test_flat_text_of_any_depth(spark):
    node = S.listing(S.Node("object", props={"b": S.text(), "a": S.listing(S.Node("object", props={"z": S.text(), "y": S.text()}))}))
    value = [{"a": [{"y": 1, "z": None, "x": [[True], []]}], "c": {"k": {"l": {"m": [1.5, "t"]}}}, "b": "first"}, 5, None]
    text = json.dumps(value)
    rows = spark.createDataFrame([(text,), (None,), ("[]",), ("[" * 500 + "7" + "]" * 500,)], "t string")
    got = [r[0] for r in rows.select(render.flatten_json(F.col("t"), node)).collect()]
    assert got == ["b=first | a=z= | y=1 | x=true ;  | c=k=l=m=1.5 ; t ; 5 ; ", "", "", "7"]
    assert rows.limit(1).select(render.flatten_json(F.col("t"))).first()[0].startswith("a=y=1 | z= | x=true ;  | c=")
    listed = frame(spark, {"p": value, "q": "no list"}).select(render.list_at("v", "p", node), render.list_at("v", "q"), render.list_at("v", "r")).first()
    assert listed[0].startswith("b=first | a=z= | y=1") and listed[1:] == ("", "")


def test_one_finding_per_keyword(spark):
    good = note(event())
    cases = {
        "type": note(event(evento_id=5)),
        "required": note({k: v for k, v in event().items() if k != "alcance"}),
        "additionalProperties": note(event(extra=1, other=2)),
        "enum": note(event(alcance={"categoria": "x"})),
        "const": {**good, "schema_version": "2"},
        "pattern": {**good, "nota": {"nota_id": "n", "fecha_publicacion": "1990", "titulo": "t"}},
        "minimum": note(event(evento_numero=0)),
        "minItems": note(event(demandas=[])),
    }
    df = frame(spark, good, *cases.values())
    assert [r.ok for r in df.select(schema_valid("v", TARGET).alias("ok")).collect()] == [True] + [False] * len(cases)
    found = R.schema_findings(df, "v", TARGET, ["k"]).collect()
    assert sorted((r.k, r.keyword) for r in found) == [(i + 1, kw) for i, kw in enumerate(cases)]
    detail = {r.k: r for r in R.validity_detail(df, "v", TARGET, "k").collect()}
    assert detail[0].valid and detail[0].errors == []
    assert detail[4].errors[0].path == "extraccion/eventos_protesta/0/alcance/categoria"
    for keyword in R.KEYWORDS:
        assert {r.keyword for r in R.schema_findings(df, "v", TARGET, ["k"], [keyword]).collect()} == {keyword}


def test_first_errors_come_by_list_position(spark):
    events = [event(evento_numero=0) for _ in range(12)]
    detail = R.validity_detail(frame(spark, note(*events)), "v", TARGET, "k").collect()[0]
    paths = [e.path for e in detail.errors]
    assert detail.error_count >= 12 and len(paths) == 10
    assert [p for p in paths if "/eventos_protesta/" in p] == [f"extraccion/eventos_protesta/{i}/evento_numero" for i in range(len(paths))][: sum("/eventos_protesta/" in p for p in paths)]


def test_integer_accepts_whole_decimal_only(spark):
    df = frame(spark, note(event(evento_numero=1.0)), note(event(evento_numero=1.5)), note(event(evento_numero="1")), note(event(es_evento_protesta=1)))
    assert [r.ok for r in df.select(schema_valid("v", TARGET).alias("ok")).collect()] == [True, False, False, False]


def test_null_contract_sees_containers(spark):
    core = {"evento_id": "e", "evento_numero": 1, "es_evento_protesta": False}
    docs = [
        note({**core, "sujetos": []}), note({**core, "incidentes": {}}), note({**core, "accion": {"descripcion_textual": None}}),
        note({**core, "accion": None}), note({**core, "es_evento_protesta": None, "accion": {}}), note({"accion": {}}),
    ]
    df = frame(spark, *docs)
    assert [r.n for r in df.select(contract.violation_count("v").alias("n")).collect()] == [1, 1, 1, 0, 0, 0]
    shown = contract.violation_context(
        contract.false_event_violations(frame(spark, note({**core, "accion": {"a": [1, None, 2], "b": "x"}})), "v", ["k"]), ["k"]
    ).collect()
    assert shown[0].leaves == ["/accion/a/0", "/accion/a/2", "/accion/b"]
    strict = contract.false_event_leaf_check(frame(spark, note({**core, "alcance": {"categoria": "S/D"}})), "v").collect()[0]
    assert (strict.violation_count, strict.sd_violation_count, strict.status) == (3, 1, "fail")


def test_projection_defaults_and_coercions(spark):
    source = {
        "nota": {"nota_id": "n", "titulo": None, "x": {"y": 1}},
        "extraccion": {
            "tiene_eventos_protesta": True, "total_eventos_protesta": 2,
            "eventos_protesta": [
                {"evento_id": "a", "evento_numero": 1, "es_evento_protesta": True, "razonamiento": "r",
                 "alcance": {"categoria": " local "}, "accion": [], "sujetos": "none",
                 "incidentes": {"represion": {"presencia": True}, "detenidos": {"presencia": None, "valor": 3}}},
                {"evento_id": "b", "evento_numero": 2, "es_evento_protesta": False, "alcance": {"categoria": "Local"}},
            ],
        },
    }
    df = frame(spark, source)
    row = json.loads(P.project(df, "v").select(F.to_json("projected").alias("j")).collect()[0].j)
    first, second = row["extraccion"]["eventos_protesta"]
    assert row["schema_version"] == "1.0.0" and row["nota"] == {"nota_id": "n", "titulo": "S/D", "fecha_publicacion": "S/D"}
    assert first["alcance"] == {"categoria": "Local"} and first["accion"] is None and first["sujetos"] == "none"
    assert first["incidentes"]["represion"] == {"presencia": "Sí", "valor_booleano": True}
    assert first["incidentes"]["detenidos"] == {"presencia": "S/D", "valor": 3, "valor_textual": "S/D"}
    assert second["alcance"] is None and second["evento_id"] == "b"
    dropped = {r.path: r.dropped for r in P.dropped_paths(df, "v").collect()}
    assert dropped == {"/nota/x": 1, "/extraccion/eventos_protesta/*/razonamiento": 1}
    judged = P.judge(df, "v")
    verdict = judged.collect()[0]
    assert not verdict.valid and verdict.source_violations == 1 and verdict.projected_violations == 0
    errors = [r.error for r in P.row_errors(judged, "v", "k").orderBy("rank").collect()]
    assert errors[0].startswith("source detail must be null") and any("sujetos" in e for e in errors[1:])


def test_dates(spark):
    cells = ["1990-01-05", "1990_01_05", "05/01/1990", "05-01-1990", "1990/01/05", "1990-1-5", " 1990-01-05 10:00", "5 Jan 1990", "pronto", "", None, "1990-02-30"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.d for r in df.orderBy("i").select(X.norm_date(F.col("c")).alias("d")).collect()]
    assert got == ["05/01/1990"] * 8 + ["S/D"] * 4


def test_wide_export(spark):
    doc = note(event(sujetos=[{"a": 1, "b": [True, None]}, {"a": "x"}]), {"evento_id": "z"})
    rows = export.wide_projection(frame(spark, doc, note()).select("v"), "v").collect()
    assert len(rows) == 3 and len(rows[0]) == 105
    assert rows[0].sujetos == "a=1 | b=true ;  ; a=x" and rows[0].nota_id == "n"
    empty = [r for r in rows if r.tiene_eventos_protesta == "false"][0]
    assert empty.evento_id == "" and empty.estado_validacion_humana == "Validado sin edicion"


def test_open_schema_is_refused():
    with pytest.raises(ValueError):
        schema_valid("v", from_json_schema({"type": "object", "properties": {"a": {"type": "string"}}}))
    assert record(a=text()).closed


def test_row_errors_name_each_contract_once(spark):
    false = event(es_evento_protesta=False, alcance={"categoria": "x"}, demandas=[])
    wrong = note(*[false] * 12, total_eventos_protesta=7)
    rows = P.row_errors(P.judge(frame(spark, wrong, note()), "v"), "v", "k").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 20
    first = rows[0].error.removeprefix("source detail must be null: ").split(", ")
    assert len(first) == 10 and first == sorted(first, key=lambda p: int(p.split("[")[1].split("]")[0]))
    assert sum("detail must be null" in r.error for r in rows) == 1
    assert rows[1].error.startswith("total_eventos_protesta=7")


def test_dates_in_any_writing(spark):
    import pandas as pd

    cells = ["1990-01-05", "5/1/1990", "05-01-1990 x", "Jan 5th, 1990", "1990.01.05", "Fri 05 Jan 1990 10:00", "1990-01-05T10:00:00Z", "12/31/1990", "5.1.90",
             "January 1990", "13.13.1990", "no date", "", " 1990/1/5 ", "19900105", "10", None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    got = [r.d for r in rows.select("k", X.norm_date(F.col("c")).alias("d")).orderBy("k").collect()]
    assert got[:3] == ["05/01/1990"] * 3 and got[-4:-1] == ["05/01/1990", "05/01/1990", got[-2]] and got[-1] == "S/D"
    for cell, day in zip(cells[3:-4], got[3:-4]):
        want = pd.to_datetime(cell, errors="coerce", dayfirst=False) if cell else pd.NaT
        assert day == ("S/D" if pd.isna(want) else want.strftime("%d/%m/%Y")), cell


def test_detail_reads_its_input_once(spark):
    plan = R.validity_detail(frame(spark, note(event())), "v", TARGET, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan


def test_validity_sees_what_the_types_of_a_list_hide(spark):
    crowd = {"hay_cantidad_mencionada": "S/D", "valor_textual": "S/D", "es_aproximada": "S/D"}
    whole, lacking = event(cantidad_participantes={**crowd, "valor": None}), event(cantidad_participantes=crowd)
    docs = [note(event(), whole), note(event(), {k: v for k, v in event().items() if k != "alcance"}), note(whole, lacking),
            note(event(evento_numero=1.0)), note(event(evento_numero=1.5)), note(event(evento_numero="1"))]
    got = [r.ok for r in frame(spark, *docs).select("k", schema_valid("v", TARGET).alias("ok")).orderBy("k").collect()]
    assert got == [True, False, False, True, False, False]


def test_null_contract_reads_its_lines_once(spark):
    from marginalia.operators import contract

    broken = note(event(es_evento_protesta=False, sujetos=[]))
    chat = {"messages": [{"role": "user", "content": "x"}, *({"role": "assistant", "content": json.dumps(broken)} for _ in range(2))]}
    lines = frame(spark, broken, note(event()), chat, {"messages": []}).withColumn("file", F.lit("f"))
    files = contract.null_contract_files(lines)
    assert "Join" not in files._jdf.queryExecution().executedPlan().toString()
    assert [(r.file, r.rows, r.violating, r.status) for r in files.collect()] == [("f", 4, 3, "FAIL")]


def test_typed_records_equal_the_cast_and_are_made_once(spark):
    from marginalia.functions.variants import read_record, valid_record
    from marginalia.operators import score

    fine, odd = note(event(), event(lugares=None)), note(event(evento_numero="1", lugares=None))
    broken = [note(event(evento_numero=0)), {**fine, "x": 1}, note({k: v for k, v in event().items() if k != "lugares"})]
    texts = [json.dumps(d) for d in (fine, odd, {"nota": fine["nota"]}, [], None, *broken)] + ["{", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("v", F.try_parse_json("t"))
    got = rows.select("k", valid_record("v", TARGET).alias("p"), read_record("t", TARGET).alias("g"), P.typed("v").alias("cast")).orderBy("k").collect()
    assert [r.k for r in got if r.p is not None] == [0] and got[0].p == got[0].cast
    assert [r.g for r in got] == [r.cast for r in got] and got[1].g.extraccion.eventos_protesta[0].evento_numero == 1
    pred = rows.select("k", F.col("t").alias("raw_text"))
    both = score.comparable(rows.select("k", F.col("t").alias("gold_json")), pred, "k")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"try_variant_get\(pv#\d+, \$, StructField", plan)) == 1
    flags = {r.k: (r.parse_valid, r.schema_valid, r.p is not None) for r in both.select("k", "parse_valid", "schema_valid", "p").collect()}
    assert flags[0] == (True, True, True) and flags[1] == (True, False, False) and flags[8] == flags[10] == (False, False, False)


def test_events_in_python_equal_the_sql_templates(spark, tmp_path):
    from marginalia.catalog import corpus as C

    texts = {-12: [f"l {i}" for i in range(40)], 8: ["a", "b\tc\"q\\", " ", "x\x01\x1f\x7f é 😀", ""], 18: [f"m {i}" for i in range(40)],
             28: ["one", "two\r", "three", "\u3000k", "four"], 22: [f"n {i}" for i in range(1100)], 5: None, None: ["q"], 35: ["", " "]}
    rows = [(d, None if t is None else "\n".join(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dated = C._dated(spark, tmp_path)
    shown = lambda t: F.substring(F.to_json(F.array(t)), F.lit(3), F.length(F.to_json(F.array(t))) - 4)
    kept = F.filter(F.split("text", "\n"), C.is_event_line)
    listed = F.transform(kept, lambda x, j: F.struct(F.col("doc_id").alias("d"), (j + 1).alias("i"), F.col("fecha").alias("f"), shown(x).alias("t"), F.md5(x).alias("h")))
    for mode, redrawn in (("target", False), ("target", True), ("source", False)):
        lines = dated.withColumn("l", listed)
        if redrawn:
            lines = lines.withColumn("l", F.expr(f"transform(l, e -> struct(e.d, e.i, e.f, e.t, {C.MUTATED} AS h))")).withColumn("l", F.expr(
                "CASE WHEN doc_id % 5 = 0 AND size(l) > 0 THEN slice(l, 1, size(l) - 1) WHEN doc_id % 7 = 0 AND size(l) > 0 THEN concat(l, slice(l, 1, 1)) ELSE l END"))
        body = F.array_join(F.expr(f"transform(l, e -> {C.event_json(mode)})"), ",")
        prose = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~C.is_event_line(x)), "\n")
        want = lines.select("doc_id", "fecha", F.size("l").alias("n"), shown(prose).alias("prose"), body.alias("body")).select("doc_id", F.expr(C.note_json(mode)).alias("j"))
        assert sorted(map(str, C._render(dated, mode, "j", redrawn).collect())) == sorted(map(str, want.collect())), (mode, redrawn)
    assert "MapInArrow" in C.gold_notes(spark, tmp_path)._jdf.queryExecution().executedPlan().toString()


def test_strip_looks_at_the_ends_alone(spark):
    space = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [space + "a" + space + "é" + space, space, "", "x", "\u200b y\u1680", "a" + " " * 300_000 + "b", "y\n\u2028", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.strip(F.col("t")).alias("s"))
    assert [r.s for r in rows.orderBy("k").collect()] == ["a" + space + "é", "", "", "x", "\u200b y\u1680", texts[5], "y", None]
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_walk_enters_only_what_leads_to_a_wanted_pattern():
    from marginalia.operators.walk import ARROW_TYPES, leads, visit

    class Unwanted:
        def __str__(self):
            raise AssertionError("this part leads nowhere")

    wanted = frozenset(["/a/*/b", "/c~1d/*", "/e"])
    doc = {"a": [{"b": 1, "x": Unwanted()}, {"x": {"y": Unwanted()}, "b": 2}, 3], "c/d": [4, 5], "f": [Unwanted()], "e": {"g": Unwanted()}}
    out = [[] for _ in ARROW_TYPES]
    visit(doc, {"pointer", "pattern"}, wanted, out, leads(wanted))
    found = list(zip(out[1], out[2], out[6], out[7], out[8]))
    assert found == [
        ("/a/0/b", "/a/*/b", "integer", "1", None), ("/a/1/b", "/a/*/b", "integer", "2", None),
        ("/c~1d/0", "/c~1d/*", "integer", "4", None), ("/c~1d/1", "/c~1d/*", "integer", "5", None), ("/e", "/e", "object", None, ["g"])]
