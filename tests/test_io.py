"""Readers, writers, chat contract, ingest and incremental runs on small files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chat, ingest as I, select as SEL
from marginalia.schema import Node, listing, record, text, whole
from marginalia.sources import readers as R, writers as W
from marginalia.streaming.incremental import incremental_ingest, remaining


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.txt", 700), ("b.txt", 41)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 3 else "\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = R.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 467 + 28
    assert all(r.line.split(" ")[1] == str(r.line_no) and r.line.split(" ")[0] in r.file for r in rows)


def test_csv_encodings_and_row_index(spark, tmp_path):
    body = 'txt_file,fecha,texto\n a ,1990-01-05,"línea ""uno""\ndos"\nb,,x\n'
    for name, data in (("l.csv", body.encode("latin-1")), ("u.csv", body.encode()), ("bom.csv", b"\xef\xbb\xbf" + body.encode())):
        (tmp_path / name).write_bytes(data)
        rows = R.note_table(R.scan_csv(spark, str(tmp_path / name)), "txt_file", "fecha", "texto").orderBy("row_index").collect()
        assert [(r.row_index, r.txt_file, r.fecha, r.texto) for r in rows] == [
            (0, "a", "1990-01-05", 'línea "uno"\ndos'), (1, "b", "", "x")]


def csv_rows(rng, n):
    """Rows with quotes, line ends and blank lines inside cells, one of them longer than many splits."""
    cell = lambda: "".join(rng.choice(["a", "ñ", '"', '""', "\n", "\n\n", "\r\n", ",", " ", ""]) for _ in range(rng.randrange(12)))
    rows = [[f"id{k}", cell(), cell()] for k in range(n)]
    rows[n // 2][1] = "long\n" * 400 + '"quoted"\n\n' * 90
    return rows


@pytest.mark.parametrize("line_end,split", [("\n", "300"), ("\r\n", "211"), ("\n", "64m")])
def test_one_large_csv_is_read_by_many_tasks(spark, tmp_path, line_end, split):
    rng = random.Random(3)
    want = []
    for name, n in (("a.csv", 150), ("b.csv", 1), ("c.csv", 40)):
        rows = csv_rows(rng, n)
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=line_end, quoting=csv.QUOTE_ALL)
        writer.writerow(["key", "one, two", "th\nree"])
        for row in rows:
            text.write(line_end * (rng.random() < 0.1))
            writer.writerow(row)
        (tmp_path / name).write_bytes(text.getvalue().encode())
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = R.scan_csv(spark, str(tmp_path))
        got = df.orderBy("row_index").collect()
        tasks = df.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.columns == ["key", "one, two", "th\nree", "row_index"]
    # an empty cell is null, quoted or not
    assert [(r.row_index, *r[:3]) for r in got] == [(k, *[c or None for c in row]) for k, row in enumerate(want)]
    assert tasks > 10 or split == "64m"


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n\n")
    (tmp_path / "e.csv").write_text("")
    assert R.scan_csv(spark, str(tmp_path / "h.csv")).collect() == []
    assert R.scan_csv(spark, str(tmp_path / "e.csv")).collect() == []


def test_row_contract(spark):
    rows = [("a", "d", "t"), (" a", "d", "t"), ("", "d", "t"), ("b", None, " "), ("c", "d", "t")]
    df = SEL.row_contract(spark.createDataFrame(rows, "id string, fecha string, texto string"), "id", "fecha", "texto")
    got = sorted((r.id, r.errors) for r in df.collect())
    assert got == [("", ["empty id"]), ("a", ["duplicate id"]), ("a", ["duplicate id"]), ("b", ["empty date", "empty text"]), ("c", [])]
    assert SEL.accepted(df).count() == 1
    with pytest.raises(Exception, match="row contract broken"):
        SEL.enforce(df).collect()
    with pytest.raises(ValueError, match="missing columns"):
        SEL.require_columns(df, ["id", "nope"])


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_offset_and_limit_beyond_a_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(SEL, "TOP", 5)
    df = spark.range(300).selectExpr("id", f"CAST(CASE '{kind}' WHEN 'date' THEN CAST(date_add(DATE '1990-01-01', CAST(id * 7 % 300 AS INT)) AS STRING) ELSE CAST(id * 7 % 300 AS STRING) END AS {kind}) AS k")
    keys = sorted(r.k for r in df.collect())
    for n in (1, 5, 6, 150, 299, 300, 301):
        assert sorted(r.k for r in SEL.slice_offset(df, "k", n).collect()) == keys[n:]
        assert sorted(r.k for r in SEL.limit_rows(df, "k", n).collect()) == keys[:n]
    repeated = df.select(F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("k"))
    values = sorted((r.k for r in repeated.collect()), key=lambda k: (k is not None, k))
    for n in (20, 100, 101, 130, 299, 300, 900):
        assert sorted((r.k for r in SEL.limit_rows(repeated, "k", n).collect()), key=lambda k: (k is not None, k)) == values[:n]
    assert SEL.limit_rows(df.limit(0), "k", 50).count() == 0 and SEL.slice_offset(df.limit(0), "k", 50).count() == 0


def test_lines_of_shards_are_shuffled_once(spark):
    df = spark.range(2000).select(F.col("id").alias("row_index"), F.expr("repeat('x', CAST(id % 37 AS INT))").alias("line"))
    plan = W.ordered_shards(df, "line", "row_index", 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "hashpartitioning" not in W.shard_ids(df, "line", "row_index", 500)._jdf.queryExecution().executedPlan().toString()


def test_manifest_defaults_and_last_line(spark, tmp_path):
    lines = ['{"custom_id":"a"}', "", '{"custom_id":"b","row_index":9,"fecha":"x","texto":"t"}', '{"custom_id":"a","fecha":"z"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = {r.custom_id: r for r in R.scan_manifest(spark, str(tmp_path)).collect()}
    assert (rows["a"].row_index, rows["a"].txt_file, rows["a"].fecha, rows["a"].texto) == (3, "a", "z", "")
    assert (rows["b"].row_index, rows["b"].fecha) == (9, "x")


def test_shards_respect_cap_and_order(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("row_index"), F.expr("repeat('x', CAST(id % 37 AS INT))").alias("line"))
    shards = W.shard_ids(df, "line", "row_index", cap=100).groupBy("shard").agg(
        F.sum("bytes").alias("b"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert all(s.b <= 100 and s.hi - s.lo + 1 == s.n for s in shards) and sum(s.n for s in shards) == 200
    with pytest.raises(Exception, match="single row exceeds"):
        W.shard_ids(df, "line", "row_index", cap=20).collect()
    W.sink_request_shards(df, str(tmp_path / "out"), "line", "row_index", cap=100)
    assert spark.read.text(str(tmp_path / "out")).count() == 200


def test_json_sink_keeps_nulls_and_text(spark, tmp_path):
    W.sink_jsonl(spark.createDataFrame([("ñ/", None)], "a string, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0].value == '{"a":"ñ/","b":null}'


def messages(*turns):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})


def test_chat_contract_order(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "a")]
    cases = [
        (messages(*good), None), ('{"messages":{}}', "messages must be a list"), (messages(*good, ("tool", "x")), "unknown role"),
        (messages(("tool", 1)), "unknown role"), (messages(*good[1:]), "missing role system"), (messages(*good, good[1]), "more than one user"),
        (messages(good[0], ("user", 5), ("assistant", "")), "non-string content of user"), (messages(*good[:2], ("assistant", "")), "empty content of assistant"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    assert [r.x for r in df.orderBy("i").select(chat.row_violation("v").alias("x")).collect()] == [e for _, e in cases]


def test_token_hook_and_gate(spark):
    df = spark.createDataFrame([("a b c",), ("a" * 9,), ("",)], "t string")
    assert [r.tokens for r in chat.count_tokens(df, "t").collect()] == [1, 2, 1]
    assert [r.tokens for r in chat.count_tokens(df, "t", chat.whitespace_tokens(F.col("t"))).collect()] == [3, 1, 0]
    assert [r.tokens for r in chat.count_tokens(df, "t", lambda batch: [len(x) for x in batch]).collect()] == [5, 9, 0]
    with pytest.raises(Exception, match="exceeds 5"):
        chat.enforce_token_gate(chat.count_tokens(df, "t", F.length("t").cast("long")), "tokens", 5).collect()


def envelope(custom_id, body=None, status=200, error=None):
    return json.dumps({"custom_id": custom_id, "error": error, "response": {"status_code": status, "body": body or {}}})


def answer(text, **more):
    return {"status": "completed", "output_text": text, **more}


TITLED = Node("object", props={"nota": Node("object", props={"titulo": text()}, required=("titulo",))}, required=("nota",))
RECORD = json.dumps({"nota": {"titulo": "t", "keep": 1}, "extraccion": {"eventos_protesta": [{"x": 1}, "odd", {"evento_id": "wrong"}]}, "own": True})


def test_ingest_rewrites_and_errors(spark):
    parts = {"output": [{"content": [{"type": "text", "text": RECORD[:20]}, {"type": "output_text", "text": RECORD[20:]}]}, {"content": None}]}
    refused = {"output": [{"content": [{"type": "text", "text": "a"}, {"type": "refusal", "refusal": "no"}]}]}
    lines = [
        envelope("a", answer(RECORD, usage={"prompt_tokens": 3, "completion_tokens": 4, "prompt_tokens_details": {"cached_tokens": 1}})),
        envelope("b", parts), "{", envelope("zz", answer(RECORD)), envelope("c", answer(RECORD), error={"code": 1}), envelope("c", {}, 500),
        envelope("c", {"status": "incomplete"}), envelope("c", refused), envelope("c", answer(" ")), envelope("c", answer("x")), envelope("c", answer("[]")),
        envelope("a", answer(RECORD, usage={"input_tokens": 10, "output_tokens": 0})), envelope("d", answer('{"nota":{}}')),
    ]
    df = R.parse_lines(spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line_no long, line string"))
    manifest = spark.createDataFrame([(c, i, c, "1990-01-05", "") for i, c in enumerate("abcd")], "custom_id string, row_index long, txt_file string, fecha string, texto string")
    rows = I.classify(df, manifest, TITLED, day="2026-01-02")
    errors = {r.line_no: (r.custom_id, r.error_type, r.error.split(":")[0]) for r in I.line_errors(rows).collect()}
    assert errors == {
        3: ("S/D", "JSONDecodeError", "line is not JSON"), 4: ("zz", "RuntimeError", "custom_id not in manifest"), 5: ("c", "RuntimeError", "remote error"),
        6: ("c", "RuntimeError", "HTTP 500"), 7: ("c", "RuntimeError", "response not completed"), 8: ("c", "RuntimeError", "request refused"),
        9: ("c", "RuntimeError", "no output text in response body"), 10: ("c", "JSONDecodeError", "answer is not JSON"),
        11: ("c", "RuntimeError", "answer is not a JSON object"), 13: ("d", "ValidationError", "record breaks the schema"),
    }
    good = I.successes(rows)
    kept = {r.custom_id: r for r in good.select("custom_id", "line_no", "usage", F.to_json("record").alias("j")).collect()}
    assert kept["a"].line_no == 12 and tuple(kept["a"].usage) == (10, 0, 10, 0)
    record = json.loads(kept["b"].j)
    assert record["own"] is True and record["nota"]["keep"] == 1 and record["nota"]["fecha_publicacion"] == "05/01/1990"
    block = record["extraccion"]
    assert (block["total_eventos_protesta"], block["tiene_eventos_protesta"], block["observaciones_extraccion"]) == (3, True, "S/D")
    assert [e["evento_id"] if isinstance(e, dict) else e for e in block["eventos_protesta"]] == ["b__evento_001", "odd", "b__evento_003"]
    assert {r.custom_id for r in I.missing_outputs(manifest, good).collect()} == {"c", "d"}
    totals = I.usage_totals(good).collect()[0]
    assert (totals.requests_with_usage, totals.input_tokens) == (2, 10)
    with pytest.raises(Exception, match="JSONDecodeError"):
        I.fail_fast(rows).collect()


def test_missing_full_text_is_an_error_row(spark):
    df = R.parse_lines(spark.createDataFrame([(i + 1, envelope(c, answer(RECORD))) for i, c in enumerate("abc")], "line_no long, line string"))
    manifest = spark.createDataFrame(
        [(c, i, c, "1990-01-05", t) for i, (c, t) in enumerate((("a", "whole"), ("b", ""), ("c", None)))],
        "custom_id string, row_index long, txt_file string, fecha string, texto string")
    rows = I.classify(df, manifest, store_text=True)
    text = F.expr("try_variant_get(record, '$.nota.texto_original', 'string')").alias("text")
    assert [tuple(r) for r in I.successes(rows).select("custom_id", text).collect()] == [("a", "whole")]
    assert sorted((r.custom_id, r.error_type) for r in I.line_errors(rows).collect()) == [("b", "RuntimeError"), ("c", "RuntimeError")]


def test_incremental_run_keeps_the_first_answer(spark, tmp_path):
    """By file path and line within a batch, by the state between batches and after a restart, without the earlier output."""
    ids = [f"n{k}" for k in range(6)]
    manifest = spark.createDataFrame([(c, i, c, "1990-01-05", "") for i, c in enumerate(ids)], "custom_id string, row_index long, txt_file string, fecha string, texto string")
    titled = lambda c, t: envelope(c, answer(json.dumps({"nota": {"titulo": t}})))
    steps = [
        {"b.jsonl": [titled("n0", "late")] + [titled("n1", f"x{k}") for k in range(40)], "a.jsonl": ["", titled("n0", "one"), "{", titled("n0", "two")]},
        {"0.jsonl": [titled("n0", "again"), titled("n2", "first"), titled("zz", "unknown"), titled("n2", "second"), envelope("n3", {}, 500)]},
        {"c.jsonl": [titled("n3", "at last"), titled("n1", "again"), titled("n2", "again"), envelope("n4", answer("[]"))]},
    ]
    (tmp_path / "in").mkdir()
    found, errors = {}, 0
    for step, files in enumerate(steps):
        for name, lines in files.items():
            (tmp_path / "in" / name).write_text("\n".join(lines))
        out, bad = str(tmp_path / f"out{step}"), str(tmp_path / f"errors{step}")  # each run sees none of the output before it
        incremental_ingest(spark, str(tmp_path / "in"), manifest, out, bad, str(tmp_path / "state"), TITLED).awaitTermination()
        for r in spark.read.parquet(out).collect():
            assert r.custom_id not in found
            found[r.custom_id] = json.loads(r.record)["nota"]["titulo"]
        errors += spark.read.parquet(bad).count()
    assert found == {"n0": "one", "n1": "x0", "n2": "first", "n3": "at last"} and errors == 4
    # the same rule over one table of the same lines
    order = [line for files in steps for name in sorted(files) for line in files[name] if line]
    table = R.parse_lines(spark.createDataFrame(list(enumerate(order)), "line_no long, line string"))
    batch = I.successes(I.classify(table, manifest, TITLED), first=True).select("custom_id", F.to_json("record").alias("r")).collect()
    assert {r.custom_id: json.loads(r.r)["nota"]["titulo"] for r in batch} == found


OPEN = Node("object", required=("a", "l"), props={
    "a": text("^x"), "n": Node("number", minimum=2), "e": Node("string", enum=("p", "q"), nullable=True), "c": Node("string", const="k"),
    "l": Node("array", min_items=1, item=Node("object", required=("i",), props={"i": whole(1), "deep": record(s=text())}))})


@pytest.mark.parametrize("doc,problem", [
    ({"a": "x", "l": [{"i": 1, "more": {"y": [1]}}], "unknown": None}, None), ({"a": "x", "l": [{"i": 1}], "n": 2.5, "c": "k", "e": "p"}, None),
    ([], "type at /"), ({"l": [{"i": 1}]}, "required a at /"), ({"a": 1, "l": []}, "type at /a"), ({"a": "y", "l": [{"i": 1}]}, "pattern at /a"),
    ({"a": "x", "l": [{"i": 1}], "n": 1}, "minimum at /n"), ({"a": "x", "l": [{"i": 1}], "e": "z"}, "enum at /e"),
    ({"a": "x", "l": [{"i": 1}], "c": "j"}, "const at /c"), ({"a": "x", "l": []}, "minItems at /l"), ({"a": "x", "l": [{"i": 3}, {}]}, "required i at /l/*"),
    ({"a": "x", "l": [{"i": 1}, {"i": 0}]}, "minimum at /l/*/i"), ({"a": "x", "l": [{"i": 1.5}]}, "type at /l/*/i"), ({"a": "x", "l": {"i": 1}}, "type at /l"),
    ({"a": "x", "l": [{"i": 1, "deep": {"s": "t", "u": 1}}]}, "additionalProperties at /l/*/deep"), ({"a": None, "l": [{"i": 1}]}, "type at /a"),
])
def test_first_broken_rule_of_an_open_schema(spark, doc, problem):
    from marginalia.functions.variants import schema_problem

    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.try_parse_json("j").alias("v"))
    assert df.select(schema_problem("v", OPEN)).first()[0] == problem


def test_closed_lists_that_keep_all_rules_are_not_listed(spark, monkeypatch):
    from marginalia.functions import variants as V

    closed = listing(record(i=whole(1), s=Node("string", enum=("p", "q")), o=record(nullable=True, t=text("^x"))), 1, nullable=True)
    schema = Node("object", required=("l",), props={"l": closed})
    good = [{"i": 1, "s": "p", "o": None}, {"i": 2, "s": "q", "o": {"t": "xy"}}]
    first, last = good
    cases = [
        (good, None), (None, None), ([], "minItems at /l"), (good + [None], "type at /l/*"), ([{**first, "i": 0}], "minimum at /l/*/i"),
        ([last, {"i": 1, "s": "p"}], "required o at /l/*"), ([last, {**first, "z": 1}], "additionalProperties at /l/*"), ([{**first, "i": "1"}], "type at /l/*/i"),
        ([first, {**first, "s": "r"}], "enum at /l/*/s"), ([{**first, "o": {"t": "y"}}], "pattern at /l/*/o/t"), ([{**first, "i": 1.0}], None), ({"i": 1}, "type at /l"),
    ]
    df = spark.createDataFrame([(k, json.dumps({"l": l, "more": 1})) for k, (l, _) in enumerate(cases)], "k int, j string")
    df = df.withColumn("v", F.try_parse_json("j"))
    got = [r.p for r in df.select("k", V.schema_problem("v", schema).alias("p")).orderBy("k").collect()]
    assert got == [problem for _, problem in cases]
    listed = V._problems
    fail = "CAST(raise_error('listed') AS STRING)"
    monkeypatch.setattr(V, "_problems", lambda v, node, *more: [fail] if node.kind == "array" else listed(v, node, *more))
    assert [r.p for r in df.where("k = 0").select(V.schema_problem("v", schema).alias("p")).collect()] == [None]


def test_incremental_run_skips_done_ids(spark, tmp_path):
    manifest = spark.createDataFrame([(c, i, c, "1990-01-05", "") for i, c in enumerate("abc")], "custom_id string, row_index long, txt_file string, fecha string, texto string")
    where = [str(tmp_path / n) for n in ("out", "errors", "state")]
    (tmp_path / "in").mkdir()
    for step, ids in enumerate((["a", "x"], ["a", "b"])):
        (tmp_path / "in" / f"{step}.jsonl").write_text("\n".join(envelope(i, answer(RECORD)) for i in ids))
        incremental_ingest(spark, str(tmp_path / "in"), manifest, *where).awaitTermination()
    out = spark.read.parquet(where[0])
    assert sorted((r.custom_id, r.batch) for r in out.collect()) == [("a", 0), ("b", 1)]
    assert [r.custom_id for r in remaining(spark, manifest, where[0]).collect()] == ["c"]
    assert spark.read.parquet(where[1]).count() == 1
