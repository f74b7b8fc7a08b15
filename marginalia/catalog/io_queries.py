"""Readers, writers, ingest, export and incremental runs over the given tables."""

from __future__ import annotations

import hashlib
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window, functions as F, types as T

from marginalia.catalog import corpus as C
from marginalia.catalog.registry import query
from marginalia.catalog.walk_queries import gold, source
from marginalia.functions import render
from marginalia.functions.paths import leaf_node
from marginalia.operators import export, ingest as I, select as SEL
from marginalia.operators.project import typed
from marginalia.schema import DATE_PATTERN, EVENTS, TARGET, Node, choice, listing, record, text, whole
from marginalia.session import ensure_checkpoint_dir, materialize, once
from marginalia.sources import readers as R, writers as W
from marginalia.streaming.incremental import incremental_ingest, remaining

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scratch(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


# --- readers and writers --------------------------------------------------------------


@query("scan_csv_encoding", """SELECT encoding, row_number() OVER (PARTITION BY encoding ORDER BY doc_id) - 1 AS row_index, 'año ' || lang AS cell, length(body) AS chars, md5(body) AS digest
    FROM (SELECT e.encoding, doc_id, lang, CASE e.encoding WHEN 'utf8' THEN '"' || text || '",' || chr(10) || source ELSE source || chr(10) || '"' || doc_id || '",' END AS body FROM documents, (VALUES ('latin1'), ('utf8')) e(encoding))""")
def _(spark, sf):
    docs = C.table(spark, sf, "documents").orderBy("doc_id")
    bodies = {"utf8": F.concat(F.lit('"'), "text", F.lit('",\n'), "source"), "latin1": F.concat("source", F.lit('\n"'), "doc_id", F.lit('",'))}
    found = []
    for name, encoding in (("latin1", "ISO-8859-1"), ("utf8", "UTF-8")):
        path = scratch(spark)
        docs.select(F.concat(F.lit("año "), "lang").alias("cell"), bodies[name].alias("body")).write.csv(path, header=True, encoding=encoding, escape='"', quoteAll=True)
        found.append(R.scan_csv(spark, path).select(F.lit(name).alias("encoding"), "row_index", "cell", F.length("body").alias("chars"), F.md5("body").alias("digest")))
    return found[0].unionByName(found[1])


def _event_lines(spark, sf) -> str:
    """Events as JSON lines with some blank and some broken lines."""
    path = scratch(spark)
    line = F.expr(
        "CASE event_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN '{broken' ELSE concat(' ', to_json(named_struct('id', event_id, "
        "'type', event_type, 'user', user_id)), ' ') END"
    )
    C.table(spark, sf, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    return path


@query("scan_jsonl", """SELECT event_type AS type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark)
    C.table(spark, sf, "events").select(
        F.explode(F.array(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))), F.lit(""))).alias("value")
    ).write.text(path)
    rows = R.scan_jsonl(spark, path)
    kind, number = F.expr("try_variant_get(v, '$.type', 'string')"), F.expr("try_variant_get(v, '$.id', 'bigint')")
    return rows.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum(number).alias("ids"))


@query("scan_line_numbers", """SELECT event_id AS id, count(*) OVER (ORDER BY event_id) AS line_no FROM events QUALIFY event_id % 10 > 1""")
def _(spark, sf):
    good, _ = R.scan_jsonl_tolerant(spark, _event_lines(spark, sf), per_file=False)
    return good.select(F.expr("try_variant_get(v, '$.id', 'bigint')").alias("id"), "line_no")


@query("scan_jsonl_tolerant", """SELECT count(*) FILTER (event_id % 10 > 1) AS readable, count(*) FILTER (event_id % 10 = 1) AS broken,
    count(DISTINCT user_id) FILTER (event_id % 10 > 1) AS users FROM events""")
def _(spark, sf):
    good, bad = R.scan_jsonl_tolerant(spark, _event_lines(spark, sf))
    users = good.select(F.expr("try_variant_get(v, '$.user', 'bigint')").alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    return users.agg(F.sum("n").alias("readable"), F.count("u").alias("users")).withColumn(
        "broken", bad.agg(F.count("*")).scalar()
    )


@query("scan_manifest", """SELECT count(*) AS n, sum(event_id)::BIGINT AS last_events, count(*) FILTER (event_id % 2 = 0) AS default_dates FROM (
    SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)""")
def _(spark, sf):
    path = scratch(spark)
    line = F.expr("to_json(named_struct('custom_id', concat('u', user_id), 'row_index', event_id, 'fecha', CASE WHEN event_id % 2 = 1 THEN '1990-01-05' END))")
    C.table(spark, sf, "events").orderBy("event_id").select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    rows = R.scan_manifest(spark, path)
    return rows.agg(
        F.count("*").alias("n"), F.sum("row_index").alias("last_events"), F.count_if(F.col("fecha") == "S/D").alias("default_dates")
    )


@query("scan_gold", C.with_notes(C.GOLD_SQL) + """ SELECT nota_id, json_array_length(gold_json, '$.extraccion.eventos_protesta') AS events FROM gold""")
def _(spark, sf):
    line = F.to_json(F.struct(F.array(
        F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("gold_json").alias("content")),
    ).alias("messages")))
    path = scratch(spark)
    C.gold_notes(spark, sf).select(line.alias("value")).write.text(path)
    rows = R.scan_gold(spark, path)
    return rows.select(
        F.expr("try_variant_get(gold, '$.nota.nota_id', 'string')").alias("nota_id"),
        F.expr("CAST(size(try_variant_get(gold, '$.extraccion.eventos_protesta', 'array<variant>')) AS BIGINT)").alias("events"),
    )


@query("sink_jsonl", """SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (doc_id % 3 = 0) AS nulls FROM documents""")
def _(spark, sf):
    path = scratch(spark)
    docs = C.table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    W.sink_jsonl(docs, path)
    lines = spark.read.text(path)
    back = lines.select(F.get_json_object("value", "$.text").alias("t"), F.col("value").contains('"lang":null').alias("null_kept"))
    return back.agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"), F.count_if("null_kept").alias("nulls"))


@query("sink_jsonl_append", """SELECT 2 * count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents""")
def _(spark, sf):
    path = scratch(spark)
    docs = C.table(spark, sf, "documents").select("doc_id")
    W.sink_jsonl(docs, path, mode="append")
    W.sink_jsonl(docs, path, mode="append")
    per_id = spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))
    return per_id.agg(F.sum("n").alias("n"), F.count("*").alias("ids"))


@query("sink_report", """SELECT count(*) AS processed, count(*) FILTER (lang = 'en') AS english, NULL::VARCHAR AS note FROM documents""")
def _(spark, sf):
    path = scratch(spark)
    report = C.table(spark, sf, "documents").agg(F.count("*").alias("processed"), F.count_if(F.col("lang") == "en").alias("english"))
    W.sink_report(report.withColumn("note", F.lit(None).cast("string")), path)
    return spark.read.schema("processed long, english long, note string").json(path)


@query("sink_csv", """SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS custkeys FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark)
    W.sink_csv(C.table(spark, sf, "orders"), path, ("o_custkey", "o_orderpriority"))
    back = spark.read.schema("o_custkey long, o_orderpriority string").csv(path, header=True)
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"))


REQUEST_SQL = """concat('{"custom_id":"doc_', doc_id, '","method":"POST","url":"/v1/responses","body":{"model":"m","input":[{"role":"system","content":"s"},',
    '{"role":"user","content":', to_json('FECHA DE EDICIÓN DE LA NOTA: 05/01/1990' || chr(10) || chr(10) || text), '}],"reasoning":{"effort":"medium"},"text":{"format":',
    '{"type":"json_schema","name":"n","schema":{"type":"object"},"strict":true},"verbosity":"low"},"max_output_tokens":16000', {key}, '}}')"""


def requests(spark, sf, cache_key=""):
    notes = C.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("txt_file"), F.lit("05/01/1990").alias("fecha"), F.col("text").alias("texto"),
        F.col("doc_id").alias("row_index"),
    )
    return notes.withColumn("line", F.to_json(I.request_struct("s", '{"type":"object"}', "m", "n", cache_key=cache_key)))


SHARD_SQL = f"""sized AS (SELECT doc_id, value, octet_length(encode(value)) + 1 AS b FROM requests),
placed AS (SELECT *, CAST((sum(b) OVER (ORDER BY doc_id) - b) // greatest(1, {{cap}} - max(b) OVER ()) AS BIGINT) AS shard FROM sized)
    SELECT shard, count(*) AS lines, sum(b)::BIGINT AS bytes, min(md5(value)) AS low, max(md5(value)) AS high, true AS in_order FROM placed GROUP BY shard"""


def shard_summary(spark, path: str, key: str):
    """Shards as they were written: lines, bytes, digests of lines, and whether each is one file in row order."""
    back = spark.read.text(path).select("shard", "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    number = F.regexp_extract("value", key, 1).cast("long")
    after = F.lag(number).over(Window.partitionBy("shard", "file").orderBy("at"))
    rows = back.withColumn("rising", F.coalesce(after < number, F.lit(True)))
    return rows.groupBy("shard").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min(F.md5("value")).alias("low"),
        F.max(F.md5("value")).alias("high"), (F.min("rising") & (F.count_distinct("file") == 1)).alias("in_order"),
    ).select(F.col("shard").cast("long"), "lines", "bytes", "low", "high", "in_order")


@query("sink_request_shards", "WITH requests AS (SELECT doc_id, " + REQUEST_SQL.replace("{key}", "''") + " AS value FROM documents), " + SHARD_SQL.format(cap=400_000))
def _(spark, sf):
    path = scratch(spark)
    W.sink_request_shards(requests(spark, sf), path, "line", "row_index", 400_000)
    return shard_summary(spark, path, r'"custom_id":"doc_(\d+)"')


# prepare: notes of a CSV whose cells span lines, some answered before, to request shards and a manifest
PREPARE_SQL = """WITH notes AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents),
kept AS (SELECT doc_id, row_index, text FROM notes JOIN documents USING (doc_id) WHERE row_index >= 10 AND doc_id % 4 <> 1),
requests AS (SELECT doc_id, concat('{"custom_id":"doc_', doc_id, '","fecha":"', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), '/02/1990","texto":',
  to_json(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '}') AS value FROM kept), """


@query("prepare_flow", PREPARE_SQL + SHARD_SQL.format(cap=500_000).replace("true AS in_order", "true AS in_order, (SELECT count(*) FROM kept) AS manifest_rows, (SELECT sum(row_index)::BIGINT FROM kept) AS row_indexes"))
def _(spark, sf):
    base = scratch(spark)
    notes = C.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.concat(F.lit(" "), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("/02/1990")).alias("date"),
        F.col("text").alias("body"), "doc_id")
    notes.orderBy("doc_id").drop("doc_id").write.csv(f"{base}/notes", header=True, escape='"', quoteAll=True)
    earlier = notes.where("doc_id % 4 = 1").select(F.concat(F.lit('{"nota":{"nota_id":"'), "id", F.lit('"}}')).alias("value"))
    earlier.write.text(f"{base}/done")

    done = R.processed_ids(R.scan_jsonl(spark, f"{base}/done"))
    rows = R.note_table(SEL.require_columns(R.scan_csv(spark, f"{base}/notes"), ["id", "date", "body"]), "id", "date", "body")
    chosen = SEL.select_rows(rows, "txt_file", "row_index", start=10, done=done, dense=True)
    checked = materialize(SEL.enforce(SEL.row_contract(chosen, "txt_file", "fecha", "texto")))
    line = F.to_json(F.struct(F.col("txt_file").alias("custom_id"), "fecha", "texto"))
    W.sink_request_shards(checked.withColumn("line", line), f"{base}/requests", "line", "row_index", 500_000)
    W.sink_jsonl(checked.select(*I.manifest_columns(True)), f"{base}/manifest")

    manifest = R.scan_manifest(spark, f"{base}/manifest").agg(F.count("*").alias("n"), F.sum("row_index").alias("s")).first()
    return shard_summary(spark, f"{base}/requests", r'"custom_id":"doc_(\d+)"').withColumns(
        {"manifest_rows": F.lit(manifest.n), "row_indexes": F.lit(manifest.s)})


@query("request_struct", f"""SELECT count(*) AS n, sum(length(a))::BIGINT AS chars, min(md5(a)) AS low, max(md5(a)) AS high, sum(length(b) - length(a))::BIGINT AS key_chars FROM (
    SELECT {REQUEST_SQL.replace('{key}', "''")} AS a, {REQUEST_SQL.replace('{key}', chr(39) + ',"prompt_cache_key":"k"' + chr(39))} AS b FROM documents)""")
def _(spark, sf):
    plain = requests(spark, sf).agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.min(F.md5("line")).alias("low"), F.max(F.md5("line")).alias("high")
    )
    keyed = requests(spark, sf, "k").agg(F.sum(F.length("line")).alias("keyed"))
    return plain.withColumn("key_chars", keyed.scalar() - F.col("chars"))


@query("manifest_struct", """SELECT count(*) AS n, sum(length(concat('{"custom_id":"doc_', doc_id, '","row_index":', doc_id, ',"txt_file":"doc_', doc_id, '","fecha":"05/01/1990"}')))::BIGINT AS chars,
    sum(length(text))::BIGINT AS text_chars FROM documents""")
def _(spark, sf):
    rows = requests(spark, sf)
    short = F.to_json(F.struct(*I.manifest_columns(store_text=False)))
    return rows.select(F.length(short).alias("c"), F.struct(*I.manifest_columns(store_text=True)).alias("m")).agg(
        F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum(F.length("m.texto")).alias("text_chars")
    )


# --- ingest: envelopes built from the gold records, one case per doc_id % 13 -------------

GOOD = "(0, 1, 11)"
CASES_SQL = """(VALUES (2, 'JSONDecodeError', 'line is not JSON'), (3, 'RuntimeError', 'custom_id not in manifest'), (4, 'RuntimeError', 'remote error'),
    (5, 'RuntimeError', 'HTTP 500'), (6, 'RuntimeError', 'response not completed'), (7, 'RuntimeError', 'request refused'),
    (8, 'RuntimeError', 'no output text in response body'), (9, 'JSONDecodeError', 'answer is not JSON'),
    (10, 'RuntimeError', 'answer is not a JSON object'), (12, 'ValidationError', 'record breaks the schema')) c(c, error_type, error)"""
# case 12 breaks one rule of the schema of answers, by 13 * the case: what the title is replaced by, and the rule
BREAKS = (
    ('"otro":"', "required titulo at /nota"), ('"titulo":5,"otro":"', "type at /nota/titulo"),
    ('"idioma":"xx","titulo":"', "enum at /nota/idioma"), ('"formato":"pdf","titulo":"', "const at /nota/formato"),
    ('"codigo":"1","titulo":"', "pattern at /nota/codigo"), ('"paginas":0,"titulo":"', "minimum at /nota/paginas"),
    ('"autores":[],"titulo":"', "minItems at /nota/autores"), ('"autores":["a",null],"titulo":"', "type at /nota/autores/*"),
    ('"origen":{"medio":"m","x":1},"titulo":"', "additionalProperties at /nota/origen"),
)
BREAK_CASE = f"CASE doc_id % {13 * len(BREAKS)} - doc_id % 13 " + " ".join(
    f"WHEN {13 * k} THEN {{{k}}}" for k in range(len(BREAKS))) + " END"
BROKEN = "replace(gold_json, '\"titulo\":\"', " + BREAK_CASE.format(*[f"'{text}'" for text, _ in BREAKS]) + ")"


def answer_schema() -> Node:
    """The schema of answers: open records whose declared keys have rules, over the events of the target schema."""
    opened = lambda required, **props: Node("object", props=props, required=required)
    nota = opened(
        ("titulo",), nota_id=text(), fecha_publicacion=text(DATE_PATTERN), titulo=text(), idioma=choice("es", "pt"),
        formato=Node("string", const="texto"), codigo=text("^[A-Z]"), paginas=whole(1), autores=listing(text(), 1), origen=record(medio=text()))
    extraccion = TARGET.props["extraccion"].props
    return opened(
        ("schema_version", "nota", "extraccion"), schema_version=text(), nota=nota,
        metadatos_extraccion=opened(("modelo",), modelo=text()), extraccion=opened(tuple(extraccion), **extraccion))


def envelopes(spark, sf):
    """``line_no, line`` with every way a response can fail; case 11 answers twice."""
    inner = (
        f"CASE c WHEN 9 THEN 'no json' WHEN 10 THEN '[1]' WHEN 12 THEN {BROKEN} "
        "WHEN 8 THEN '  ' WHEN 7 THEN NULL WHEN 1 THEN NULL ELSE gold_json END"
    )
    part = "named_struct('type', {t}, 'text', {x}, 'refusal', {r})"
    no = "CAST(NULL AS STRING)"
    output = (
        "CASE c WHEN 1 THEN array(named_struct('content', array("
        + part.format(t="'output_text'", x="substr(gold_json, 1, 40)", r=no) + ", "
        + part.format(t="'text'", x="substr(gold_json, 41)", r=no) + "))) WHEN 7 THEN array(named_struct('content', array("
        + part.format(t="'text'", x="'a'", r=no) + ", " + part.format(t="'refusal'", x=no, r="'not this'") + "))) END"
    )
    usage = (
        "CASE WHEN c = 1 THEN named_struct('input_tokens', CAST(NULL AS BIGINT), 'output_tokens', CAST(NULL AS BIGINT), 'total_tokens', CAST(NULL AS BIGINT), "
        "'prompt_tokens', doc_id, 'completion_tokens', 5L, 'input_tokens_details', NULL, 'prompt_tokens_details', named_struct('cached_tokens', 2L)) "
        "ELSE named_struct('input_tokens', doc_id + copy, 'output_tokens', 7L, 'total_tokens', doc_id + copy + 7, 'prompt_tokens', NULL, "
        "'completion_tokens', NULL, 'input_tokens_details', named_struct('cached_tokens', 3L), 'prompt_tokens_details', NULL) END"
    )
    notes = C.gold_notes(spark, sf).withColumn("c", F.expr("CAST(doc_id % 13 AS INT)")).withColumn(
        "copy", F.explode(F.when(F.col("c") == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    envelope = F.expr(
        "to_json(named_struct('custom_id', CASE WHEN c = 3 THEN concat('unknown_', doc_id) ELSE nota_id END, "
        "'error', CASE WHEN c = 4 THEN named_struct('code', 'x') END, 'response', named_struct('status_code', CASE WHEN c = 5 THEN 500 ELSE 200 END, "
        f"'body', named_struct('status', CASE WHEN c = 6 THEN 'incomplete' ELSE 'completed' END, 'output_text', {inner}, 'output', {output}, 'usage', {usage}))))"
    )
    line = F.when(F.col("c") == 2, F.lit('{"custom_id": ')).otherwise(envelope)
    return notes.select((F.col("doc_id") * 2 + F.col("copy")).alias("line_no"), line.alias("line"))


def manifest(spark, sf):
    return C.lines(spark, sf).select(
        F.concat(F.lit("doc_"), "doc_id").alias("custom_id"), F.col("doc_id").alias("row_index"),
        F.concat(F.lit("doc_"), "doc_id").alias("txt_file"), "fecha", "texto",
    )


SETTINGS = {"model": "m", "prompt_version": "p", "remarks": "r", "day": "2026-01-02"}


def classified(spark, sf):
    return I.classify(R.parse_lines(envelopes(spark, sf)), manifest(spark, sf), answer_schema(), **SETTINGS)


@query("ingest_errors", f"""SELECT error_type, CASE WHEN c = 12 THEN error || ': ' || {BREAK_CASE.format(*[f"'{rule}'" for _, rule in BREAKS])} ELSE error END AS error,
    count(*) AS n, sum(doc_id * 2)::BIGINT AS lines FROM documents JOIN {CASES_SQL} ON doc_id % 13 = c GROUP BY ALL""")
def _(spark, sf):
    said = F.when(F.col("error_type") == I.INVALID, F.col("error")).otherwise(F.split("error", ":")[0]).alias("error")
    return I.line_errors(classified(spark, sf)).groupBy("error_type", said).agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


@query("ingest_dedupe", f"""SELECT 'doc_' || doc_id AS custom_id, doc_id * 2 + CASE WHEN doc_id % 13 = 11 THEN 1 ELSE 0 END AS line_no FROM documents WHERE doc_id % 13 IN {GOOD}""")
def _(spark, sf):
    return I.successes(classified(spark, sf)).select("custom_id", "line_no")


@query("join_response_manifest", """SELECT doc_id % 13 NOT IN (2, 3) AS known, count(*) + count(*) FILTER (doc_id % 13 = 11) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    return classified(spark, sf).groupBy(F.col("row_index").isNotNull().alias("known")).agg(F.count("*").alias("n"))


@query("missing_outputs", f"SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 13 NOT IN {GOOD}")
def _(spark, sf):
    missing = I.missing_outputs(manifest(spark, sf), I.successes(classified(spark, sf)))
    return missing.agg(F.count("*").alias("n"), F.sum(F.substring("custom_id", 5, 20).cast("long")).alias("ids"))


@query("in_manifest_order", f"SELECT 'doc_' || doc_id AS custom_id, doc_id AS row_index FROM documents WHERE doc_id % 13 IN {GOOD} ORDER BY doc_id")
def _(spark, sf):
    return I.in_manifest_order(I.successes(classified(spark, sf))).select("custom_id", "row_index")


@query("usage_totals", f"""SELECT count(*) AS requests_with_usage, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens, sum(k)::BIGINT AS cached_input_tokens FROM (
    SELECT doc_id + CASE WHEN doc_id % 13 = 11 THEN 1 ELSE 0 END AS i, CASE WHEN doc_id % 13 = 1 THEN 5 ELSE 7 END AS o, CASE WHEN doc_id % 13 = 1 THEN 2 ELSE 3 END AS k FROM documents WHERE doc_id % 13 IN {GOOD})""")
def _(spark, sf):
    return I.usage_totals(I.successes(classified(spark, sf)))


@query("usage_per_id", f"""SELECT 'doc_' || doc_id AS custom_id, doc_id AS row_index, doc_id + CASE WHEN doc_id % 13 = 11 THEN 1 ELSE 0 END AS input_tokens,
    CASE WHEN doc_id % 13 = 1 THEN 5 ELSE 7 END AS output_tokens, doc_id + CASE doc_id % 13 WHEN 11 THEN 8 WHEN 1 THEN 5 ELSE 7 END AS total_tokens,
    CASE WHEN doc_id % 13 = 1 THEN 2 ELSE 3 END AS cached_input_tokens FROM documents WHERE doc_id % 13 IN {GOOD}""")
def _(spark, sf):
    return I.usage_per_id(I.successes(classified(spark, sf)))


def _bodies(spark, sf):
    rows = R.parse_lines(envelopes(spark, sf))
    return once(rows, body=F.expr("try_variant_get(v, '$.response.body', 'variant')"))


@query("usage_struct", """SELECT c, count(*) AS n, sum(CASE WHEN c = 2 THEN 0 ELSE doc_id + copy END)::BIGINT AS input_tokens, sum(CASE WHEN c = 2 THEN 0 WHEN c = 1 THEN 5 ELSE 7 END)::BIGINT AS output_tokens FROM (
    SELECT doc_id, doc_id % 13 AS c, unnest(CASE WHEN doc_id % 13 = 11 THEN [0, 1] ELSE [0] END) AS copy FROM documents) GROUP BY c""")
def _(spark, sf):
    case = F.floor(F.col("line_no") / 2) % 13
    rows = once(_bodies(spark, sf), u=I.usage_struct("body"))
    return rows.groupBy(case.alias("c")).agg(
        F.count("*").alias("n"), F.sum("u.input_tokens").alias("input_tokens"), F.sum("u.output_tokens").alias("output_tokens")
    )


@query("response_text", C.with_notes(C.GOLD_SQL) + f""" SELECT coalesce(CASE c WHEN 2 THEN 'no output text in response body' WHEN 6 THEN 'response not completed' WHEN 7 THEN 'request refused' WHEN 8 THEN 'no output text in response body' END, 'ok') AS outcome,
    sum(CASE WHEN c = 11 THEN 2 ELSE 1 END)::BIGINT AS n, coalesce(sum(CASE c WHEN 2 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 7 WHEN 10 THEN 3 WHEN 11 THEN 2 * length(gold_json) WHEN 12 THEN length({BROKEN}) ELSE length(gold_json) END), 0)::BIGINT AS chars
    FROM (SELECT *, doc_id % 13 AS c FROM gold) GROUP BY 1""")
def _(spark, sf):
    rows = once(_bodies(spark, sf), answer=I.response_text("body"))
    outcome = F.coalesce(F.split("answer.error", ":")[0], F.lit("ok"))
    return rows.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("answer.text")), F.lit(0)).alias("chars")
    )


@query("ingest_counts", f"""SELECT part, ok, errors, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM (
    SELECT 'all' AS part, count(*) FILTER (doc_id % 13 IN {GOOD}) AS ok, 2 * count(*) FILTER (doc_id % 13 NOT IN {GOOD}) AS errors FROM documents
    UNION ALL SELECT 'good', count(*) FILTER (doc_id % 13 IN {GOOD}), count(*) FILTER (doc_id % 13 IN {GOOD} AND doc_id % 13 NOT IN {GOOD}) FROM documents)""")
def _(spark, sf):
    rows = materialize(classified(spark, sf).drop("record", "usage"))
    # the second run's input and manifest hold only notes that are answered well
    known = manifest(spark, sf)
    runs = {"all": (rows, known), "good": (rows.where(F.expr(f"line_no DIV 2 % 13 IN {GOOD}")), known.where(f"row_index % 13 IN {GOOD}"))}
    found = []
    for name, (lines, asked) in runs.items():
        good = I.successes(lines.withColumns({"record": F.lit(None), "usage": F.lit(None)}))
        errors = I.errors_union(I.line_errors(lines), I.missing_outputs(asked, good))
        found.append(I.ingest_counts(good, errors).withColumn("part", F.lit(name)))
    return found[0].unionByName(found[1])


@query("errors_union", f"""SELECT error_type, count(*) AS n, count(raw) AS raws FROM (
    SELECT error_type, NULL AS raw FROM documents JOIN {CASES_SQL} ON doc_id % 13 = c
    UNION ALL SELECT 'MissingOutput', NULL FROM documents WHERE doc_id % 13 NOT IN {GOOD}
    UNION ALL SELECT 'BatchErrorFile', 'x' FROM documents WHERE quality_low) GROUP BY ALL""".replace("WHERE quality_low", "WHERE length(text) < 500"))
def _(spark, sf):
    rows = materialize(classified(spark, sf).drop("record", "usage"))
    good = I.successes(rows.withColumns({"record": F.lit(None), "usage": F.lit(None)}))
    remote = C.table(spark, sf, "documents").where(F.length("text") < 500).select(
        F.try_parse_json(F.to_json(F.struct(F.col("doc_id").alias("id")))).alias("v"))
    whole = I.errors_union(I.line_errors(rows), I.missing_outputs(manifest(spark, sf), good), I.remote_errors(remote))
    return whole.groupBy("error_type").agg(F.count("*").alias("n"), F.count("raw").alias("raws"))


@query("stamp_note", C.with_notes(C.GOLD_SQL) + f""" SELECT nota_id, json_extract_string(gold_json, '$.nota.fecha_publicacion') AS fecha, nota_id AS archivo, 'S/D' AS texto,
    '1.1.0' AS version, '2026-01-02' AS dia, json_extract_string(gold_json, '$.nota.titulo') AS titulo, 9 AS meta_keys FROM gold WHERE doc_id % 13 IN {GOOD}""")
def _(spark, sf):
    at = lambda path: F.expr(f"try_variant_get(record, '$.{path}', 'string')")
    return I.successes(classified(spark, sf)).select(
        at("nota.nota_id").alias("nota_id"), at("nota.fecha_publicacion").alias("fecha"), at("nota.archivo_fuente").alias("archivo"),
        at("nota.texto_original").alias("texto"), at("schema_version").alias("version"),
        at("metadatos_extraccion.fecha_extraccion").alias("dia"), at("nota.titulo").alias("titulo"),
        F.expr("CAST(size(try_variant_get(record, '$.metadatos_extraccion', 'map<string,variant>')) AS BIGINT)").alias("meta_keys"),
    )


@query("renumber_events", C.with_notes(C.PRED_SQL) + """ SELECT nota_id, n AS total, n > 0 AS has, n * (n + 1) // 2 AS numbers,
    CASE WHEN n > 0 THEN nota_id || '__evento_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END ELSE '' END AS last_id, 'S/D' AS remark FROM (
    SELECT nota_id, CAST(json_array_length(raw_text, '$.extraccion.eventos_protesta') AS BIGINT) AS n FROM pred WHERE parse_valid)""")
def _(spark, sf):
    # predictions repeat or drop events, so their stated numbers are off
    rows = once(C.pred_notes(spark, sf), v=F.try_parse_json("raw_text")).where(F.col("v").isNotNull())
    block = I.renumber_events("try_variant_get(v, '$.extraccion', 'variant')", "nota_id")
    rows = once(rows.select("nota_id", "v"), x=F.expr(block))
    events = F.expr("try_variant_get(x, '$.eventos_protesta', 'array<struct<evento_id:string,evento_numero:bigint>>')")
    return once(rows, e=events).select(
        "nota_id", F.expr("try_variant_get(x, '$.total_eventos_protesta', 'bigint')").alias("total"),
        F.expr("try_variant_get(x, '$.tiene_eventos_protesta', 'boolean')").alias("has"),
        F.aggregate("e", F.lit(0).cast("long"), lambda acc, e: acc + e["evento_numero"]).alias("numbers"),
        F.coalesce(F.expr("get(e, size(e) - 1).evento_id"), F.lit("")).alias("last_id"),
        F.expr("try_variant_get(x, '$.observaciones_extraccion', 'string')").alias("remark"),
    )


# --- incremental run ------------------------------------------------------------------


@query("incremental_resume", f"""SELECT count(*) FILTER (doc_id % 13 IN {GOOD}) AS written, count(*) FILTER (doc_id % 13 NOT IN {GOOD}) AS remaining, count(*) FILTER (doc_id % 13 NOT IN {GOOD}) AS errors FROM documents""")
def _(spark, sf):
    base = scratch(spark)
    known = materialize(manifest(spark, sf))
    lines = envelopes(spark, sf)
    for part in (0, 1):
        # both runs find the files of the first half; only new files are read
        half = lines.where(F.floor(F.col("line_no") / 2) % 2 == part)
        half.select(F.col("line").alias("value")).write.mode("append").text(f"{base}/in")
        run = incremental_ingest(spark, f"{base}/in", known, f"{base}/out", f"{base}/errors", f"{base}/state", answer_schema(), **SETTINGS)
        run.awaitTermination()
    written = spark.read.parquet(f"{base}/out").agg(F.count("*").alias("written"))
    errors = spark.read.parquet(f"{base}/errors").agg(F.count("*").alias("errors"))
    left = remaining(spark, known, f"{base}/out").agg(F.count("*").alias("remaining"))
    return written.withColumn("errors", errors.scalar()).withColumn("remaining", left.scalar())


# --- export ---------------------------------------------------------------------------


@query("explode_events", C.with_notes(C.SOURCE_SQL) + """ SELECT nota_id, greatest(1, json_array_length(source_json, '$.extraccion.eventos_protesta')) AS rows,
    CAST(json_array_length(source_json, '$.extraccion.eventos_protesta') AS BIGINT) AS events FROM source""")
def _(spark, sf):
    rows = export.explode_events(source(spark, sf).select("nota_id", "v"), "v")
    return rows.groupBy("nota_id").agg(F.count("*").alias("rows"), F.count("event").alias("events"))


NOTE_CELLS = (*export.NOTE_COLUMNS, *export.REVIEW_COLUMNS)
WIDE_COLUMNS = [n for n, _ in export.NOTE_COLUMNS] + ["estado_validacion_humana", "tags_topicos", "modificado_por"] + [
    n for n, _ in (*export.REVIEW_COLUMNS, *export.EVENT_COLUMNS)]


#: Levels of the corpus below these lists; others hold records of texts, or texts.
LEVELS = {"sujetos": 5, "demandas": 3}


def flat_sql(x: str, depth: int) -> str:
    """DuckDB text of a JSON value to a depth, keys as they stand."""
    if depth == 0:
        return f"coalesce({x} ->> '$', '')"
    k, y = f"k{depth}", f"y{depth}"
    return (f"CASE json_type({x}) WHEN 'OBJECT' THEN array_to_string(list_transform(json_keys({x}), lambda {k}: concat({k}, '=', "
            f"{flat_sql(f'json_extract({x}, {k})', depth - 1)})), ' | ') WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract({x}, '$[*]'), "
            f"lambda {y}: {flat_sql(y, depth - 1)}), ' ; ') ELSE coalesce({x} ->> '$', '') END")


def _cells_sql(columns, value: str) -> str:
    cell = lambda path: (
        f"CASE WHEN json_type({value}, '$.{path[:-2]}') = 'ARRAY' THEN {flat_sql(f'json_extract({value}, {chr(39)}$.{path[:-2]}{chr(39)})', LEVELS.get(path[:-2], 2))} ELSE '' END"
        if path.endswith("[]") else f"coalesce(json_extract_string({value}, '$.{path}'), '')")
    return ", ".join(f'{cell(path)} AS "{name}"' for name, path in columns)


WIDE_SQL = C.with_notes(C.SOURCE_SQL) + f""",
notes AS (SELECT greatest(1, json_array_length(source_json, '$.extraccion.eventos_protesta')) AS w, {_cells_sql(NOTE_CELLS, 'source_json')},
  CASE WHEN source_json ->> '$.validacion_humana.modificada' = 'true' THEN 'Validado con edicion' ELSE 'Validado sin edicion' END AS estado_validacion_humana,
  coalesce(array_to_string(json_extract_string(source_json, '$.validacion_humana.tags_topicos[*]'), '; '), '') AS tags_topicos,
  CASE WHEN source_json ->> '$.validacion_humana.modificada' = 'true' THEN coalesce(nullif(source_json ->> '$.validacion_humana.usuario_validador', ''), 'S/D') ELSE '' END AS modificado_por FROM source),
evs AS (SELECT unnest(CASE WHEN json_array_length(source_json, '$.extraccion.eventos_protesta') = 0 THEN [NULL] ELSE json_extract(source_json, '$.extraccion.eventos_protesta[*]') END) AS e FROM source),
events AS (SELECT 1 AS w, {_cells_sql(export.EVENT_COLUMNS, 'e')} FROM evs),
cells AS (SELECT * FROM (UNPIVOT notes ON COLUMNS(* EXCLUDE (w)) INTO NAME name VALUE cell) UNION ALL SELECT * FROM (UNPIVOT events ON COLUMNS(* EXCLUDE (w)) INTO NAME name VALUE cell))
    SELECT name, sum(w)::BIGINT AS rows, coalesce(sum(w) FILTER (cell <> ''), 0)::BIGINT AS filled, sum(w * length(cell))::BIGINT AS chars, max(cell) AS high,
      sum(w * CAST('0x' || substr(md5(cell), 1, 8) AS BIGINT))::BIGINT AS digests FROM cells GROUP BY name"""


def _summed_cells(batches):
    """Batches of text columns as ``name, rows, filled, chars, high, digests``; what equal cells give is worked out once per batch."""
    for batch in batches:
        summed = []
        for name, column in zip(batch.schema.names, batch.columns):
            counted = [(c["values"], c["counts"]) for c in column.value_counts().to_pylist() if c["values"] is not None]
            summed.append((
                name, batch.num_rows, sum(n for cell, n in counted if cell), sum(n * len(cell) for cell, n in counted) if counted else None,
                max((cell for cell, _ in counted), default=None),
                sum(n * int(hashlib.md5(cell.encode(), usedforsecurity=False).hexdigest()[:8], 16) for cell, n in counted) if counted else None))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*summed), types)], names=SUMMARY.names)


SUMMARY = T.StructType([T.StructField(c, T.StringType() if c in ("name", "high") else T.LongType())
                        for c in ("name", "rows", "filled", "chars", "high", "digests")])


def cell_summary(flat):
    """Per column: rows, filled cells, their length, greatest cell, and a sum over digests of all cells.

    A batch is summed up column by column; a row per cell, grouped by name, would be sorted for the greatest text.
    """
    sums = flat.mapInArrow(_summed_cells, SUMMARY).where("rows > 0")
    return sums.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("chars").alias("chars"), F.max("high").alias("high"),
        F.sum("digests").alias("digests"))


@query("wide_projection", WIDE_SQL)
def _(spark, sf):
    return cell_summary(export.wide_projection(source(spark, sf).select("v"), "v"))


@query("sink_wide_table", WIDE_SQL)
def _(spark, sf):
    path = scratch(spark)
    W.sink_wide_table(export.wide_projection(source(spark, sf).select("v"), "v"), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return cell_summary(back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns]))


@query("flatten_value", C.with_notes(C.GOLD_SQL) + """,
ev AS (SELECT json_extract(gold_json, '$.extraccion.eventos_protesta[*]') AS es FROM gold),
subj AS (SELECT array_to_string(list_transform(json_extract(e, '$.sujetos[*]'), lambda s: concat('sujeto_id=', s ->> '$.sujeto_id', ' | nombre_textual=', s ->> '$.nombre_textual', ' | categoria=', s ->> '$.categoria',
    ' | organizaciones=', array_to_string(list_transform(json_extract(s, '$.organizaciones[*]'), lambda o: concat('organizacion_id=', o ->> '$.organizacion_id', ' | nombre_textual=', o ->> '$.nombre_textual', ' | categoria=', o ->> '$.categoria')), ' ; '))), ' ; ') AS cell
  FROM (SELECT unnest(es) AS e FROM ev) WHERE json_type(e, '$.sujetos') = 'ARRAY')
    SELECT count(*) AS n, sum(length(cell))::BIGINT AS chars, min(md5(cell)) AS low, max(md5(cell)) AS high FROM subj""")
def _(spark, sf):
    notes = once(gold(spark, sf), g=typed("v"))
    events = notes.select(F.explode("g.extraccion.eventos_protesta").alias("e")).where("e.sujetos IS NOT NULL")
    cells = events.select(render.flatten_typed("e.sujetos", leaf_node(TARGET, EVENTS + "sujetos")).alias("cell"))
    return cells.agg(F.count("*").alias("n"), F.sum(F.length("cell")).alias("chars"), F.min(F.md5("cell")).alias("low"), F.max(F.md5("cell")).alias("high"))


@query("review_status", """SELECT CASE WHEN doc_id % 3 = 1 THEN 'Validado con edicion' ELSE 'Validado sin edicion' END AS status, CASE WHEN doc_id % 3 = 1 THEN 'S/D' ELSE '' END AS editor,
    CASE WHEN doc_id % 3 = 1 THEN 'a; b' ELSE '' END AS tags, count(*) AS n FROM documents GROUP BY ALL""")
def _(spark, sf):
    rows = source(spark, sf).select(
        render.review_status("v").alias("status"), render.review_editor("v").alias("editor"), render.review_tags("v").alias("tags")
    )
    return rows.groupBy("status", "editor", "tags").agg(F.count("*").alias("n"))


@query("render_value", """SELECT shown, rendered, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN '—' WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS shown,
    CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE source END AS rendered FROM documents) GROUP BY ALL""")
def _(spark, sf):
    docs = C.table(spark, sf, "documents")
    value = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    cell = F.to_json(F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("s")), {"ignoreNullFields": "false"})
    rows = once(docs.select(value.alias("t"), cell.alias("j")), x=F.expr("try_variant_get(try_parse_json(j), '$.s', 'variant')"))
    return rows.groupBy(render.shown(F.col("t")).alias("shown"), render.rendered("x").alias("rendered")).agg(F.count("*").alias("n"))
