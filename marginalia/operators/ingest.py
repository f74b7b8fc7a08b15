"""Ingest of response envelopes: typed errors, rewritten records, usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.sqltext import quote
from marginalia.functions.text import input_text, norm_date
from marginalia.functions.variants import entries, is_object, schema_problem
from marginalia.schema import SD, Node
from marginalia.session import once
from marginalia.sources.readers import last_per_key

# Versions, labels and error names of the annotation pipeline.
SCHEMA_VERSION = "1.1.0"
CODEBOOK_VERSION = "2026-05-31_revision_LLM"
ENDPOINT = "/v1/responses"
PROVIDER = "OpenAI"
EXTRACTOR = "LLM"
PROCESSING = "Batch API"
REVIEW_STATE = "No validado"
BAD_JSON, FAILED, INVALID = "JSONDecodeError", "RuntimeError", "ValidationError"
MISSING, REMOTE = "MissingOutput", "BatchErrorFile"
MISSING_TEXT = "No hay salida exitosa para este custom_id"
USAGE = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens")


# --- requests -----------------------------------------------------------------------


def request_struct(
    system: str, schema_json: str, model: str, schema_name: str, effort: str = "medium", verbosity: str = "low",
    max_output_tokens: int = 16000, cache_key: str = "",
) -> Column:
    """Nested request record of a note row; the cache key only where one is given."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    form = F.struct(
        F.lit("json_schema").alias("type"), F.lit(schema_name).alias("name"),
        F.parse_json(F.lit(schema_json)).alias("schema"), F.lit(True).alias("strict"),
    )
    body = [
        F.lit(model).alias("model"),
        F.array(turn("system", F.lit(system)), turn("user", input_text(F.col("fecha"), F.col("texto")))).alias("input"),
        F.struct(F.lit(effort).alias("effort")).alias("reasoning"),
        F.struct(form.alias("format"), F.lit(verbosity).alias("verbosity")).alias("text"),
        F.lit(max_output_tokens).alias("max_output_tokens"),
    ]
    if cache_key:
        body.append(F.lit(cache_key).alias("prompt_cache_key"))
    return F.struct(
        F.col("txt_file").alias("custom_id"), F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"),
        F.struct(*body).alias("body"),
    )


def manifest_columns(store_text: bool) -> list[Column]:
    fields = [F.col("txt_file").alias("custom_id"), F.col("row_index"), F.col("txt_file"), F.col("fecha")]
    return fields + [F.col("texto")] if store_text else fields


# --- response bodies ----------------------------------------------------------------


def _get(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


_PARTS = (
    "flatten(transform(coalesce(try_variant_get({b}, '$.output', 'array<variant>'), array()), "
    "o -> coalesce(try_variant_get(o, '$.content', 'array<variant>'), array())))"
)


def response_text(body: str) -> Column:
    """``struct<text, error>``: the answer text of a response body, or why there is none.

    A refusal anywhere fails the response even where text parts come before it.
    """
    parts = _PARTS.format(b=body)
    status = _get(body, "status")
    refusal = f"filter({parts}, p -> {_get('p', 'type')} IN ('refusal', 'output_refusal'))"
    texts = (
        f"filter({parts}, p -> {_get('p', 'type')} IN ('output_text', 'text') "
        "AND schema_of_variant(try_variant_get(p, '$.text', 'variant')) = 'STRING')"
    )
    direct = f"CASE WHEN schema_of_variant({_get(body, 'output_text', 'variant')}) = 'STRING' THEN {_get(body, 'output_text')} END"
    joined = f"array_join(transform({texts}, p -> {_get('p', 'text')}), '')"
    ok = lambda text: f"named_struct('text', {text}, 'error', CAST(NULL AS STRING))"
    bad = lambda text: f"named_struct('text', CAST(NULL AS STRING), 'error', {text})"
    refused = f"coalesce({_get('r', 'refusal')}, {_get('r', 'text')}, 'null')"
    return F.expr(
        f"CASE WHEN coalesce({status}, '') NOT IN ('', 'completed') THEN "
        + bad(f"concat('response not completed: status=', {status}, '; details=', coalesce({_get(body, 'incomplete_details')}, 'null'))")
        + f" WHEN {direct} RLIKE '\\\\S' THEN {ok(direct)}"
        + f" WHEN size({refusal}) > 0 THEN " + bad(f"concat('request refused: ', transform(slice({refusal}, 1, 1), r -> {refused})[0])")
        + f" WHEN size({texts}) > 0 THEN {ok(joined)} ELSE " + bad("'no output text in response body'") + " END"
    )


def usage_struct(body: str) -> Column:
    """Token usage with the names of either API generation; null counts as zero."""
    n = lambda path: _get(body, f"usage.{path}", "bigint")
    absent = lambda path: f"{_get(body, f'usage.{path}', 'variant')} IS NULL"
    either = lambda a, b: f"coalesce(CASE WHEN {absent(a)} THEN {n(b)} ELSE {n(a)} END, 0)"
    tokens_in, tokens_out = either("input_tokens", "prompt_tokens"), either("output_tokens", "completion_tokens")
    total = f"coalesce(CASE WHEN {absent('total_tokens')} THEN {tokens_in} + {tokens_out} ELSE {n('total_tokens')} END, 0)"
    cached = f"coalesce({n('input_tokens_details.cached_tokens')}, {n('prompt_tokens_details.cached_tokens')}, 0)"
    return F.expr(
        f"named_struct('input_tokens', {tokens_in}, 'output_tokens', {tokens_out}, 'total_tokens', {total}, "
        f"'cached_input_tokens', {cached})"
    )


# --- rewriting ----------------------------------------------------------------------


def _with_keys(v: str, **values: str) -> str:
    """SQL of an object with some keys set, all others kept; anything else counts as empty."""
    keys = ", ".join(quote(k) for k in values)
    new = ", ".join(f"{quote(k)}, {e}" for k, e in values.items())
    kept = f"map_filter(coalesce({entries(v)}, CAST(map() AS MAP<STRING, VARIANT>)), (k, x) -> k NOT IN ({keys}))"
    return f"to_variant_object(map_concat({kept}, map({new})))"


def _text(value: str) -> str:
    return f"CAST({value} AS VARIANT)"


def renumber_events(extraction: str, note_id: str) -> str:
    """SQL of the extraction block with numbered events and matching totals."""
    found = f"coalesce(try_variant_get({extraction}, '$.eventos_protesta', 'array<variant>'), CAST(array() AS ARRAY<VARIANT>))"
    event = _with_keys(
        "e", evento_numero="CAST(i + 1 AS VARIANT)",
        evento_id=_text(f"concat({note_id}, '__evento_', format_string('%03d', i + 1))"),
    )
    numbered = f"to_variant_object(transform({found}, (e, i) -> CASE WHEN {is_object('e')} THEN {event} ELSE e END))"
    remark = _get(extraction, "observaciones_extraccion")
    return _with_keys(
        extraction, eventos_protesta=numbered, total_eventos_protesta=f"CAST(size({found}) AS VARIANT)",
        tiene_eventos_protesta=f"CAST(size({found}) > 0 AS VARIANT)",
        observaciones_extraccion=_text(f"CASE WHEN coalesce({remark}, '') = '' THEN '{SD}' ELSE {remark} END"),
    )


def stamp_note(
    parsed: str, note_id: str, date: str, text: str | None, model: str, prompt_version: str, remarks: str, day: str | None = None
) -> Column:
    """The record with deterministic metadata, whatever the model wrote there.

    ``text`` is the column with the full text to store, or None to store none. ``day``
    overrides the UTC extraction date.
    """
    today = quote(day) if day else "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd')"
    body = f"'{SD}'"
    if text:
        body = f"coalesce({text}, '')"
    meta = {
        "modelo": quote(model), "proveedor": quote(PROVIDER), "fecha_extraccion": today,
        "prompt_version": quote(prompt_version), "extractor_tipo": quote(EXTRACTOR), "modo_procesamiento": quote(PROCESSING),
        "estado_validacion_humana": quote(REVIEW_STATE), "observaciones_metodologicas": quote(remarks),
        "codebook_version": quote(CODEBOOK_VERSION),
    }
    nota = _with_keys(
        f"try_variant_get({parsed}, '$.nota', 'variant')", nota_id=_text(note_id), archivo_fuente=_text(note_id),
        fecha_publicacion=_text(date), texto_original=_text(body),
    )
    record = "to_variant_object(named_struct(" + ", ".join(f"{quote(k)}, {v}" for k, v in meta.items()) + "))"
    return F.expr(
        _with_keys(
            parsed, schema_version=_text(quote(SCHEMA_VERSION)), codebook_version=_text(quote(CODEBOOK_VERSION)), nota=nota,
            metadatos_extraccion=record,
            extraccion=renumber_events(f"try_variant_get({parsed}, '$.extraccion', 'variant')", note_id),
        )
    )


# --- the ingest ---------------------------------------------------------------------


def classify(
    lines: DataFrame, manifest: DataFrame, schema: Node | None = None, model: str = "model", prompt_version: str = "v1",
    remarks: str = "", store_text: bool = False, day: str | None = None,
) -> DataFrame:
    """Envelope lines (``line_no, v``) as ``custom_id, line_no, error_type, error, record, usage, row_index``.

    The first failing check of a line names its error: JSON, known id, remote error, HTTP
    status, response text, inner JSON, object root, full text (if it is to be stored and the
    manifest has none), schema. ``schema`` may be open; the error names the first rule that the
    stamped record breaks. The one shuffle is the join with the manifest.
    """
    known = manifest.select(
        F.col("custom_id").alias("__id"), "row_index", "txt_file", norm_date(F.col("fecha")).alias("__date"), "texto"
    )
    read = lines.select(
        "line_no", "v", F.coalesce(F.expr(_get("v", "custom_id")), F.lit(SD)).alias("custom_id")
    )
    joined = once(
        read.join(known, F.col("custom_id") == F.col("__id"), "left"),
        body=F.expr("try_variant_get(v, '$.response.body', 'variant')"),
    )
    answered = once(joined, answer=response_text("body"))
    parsed = once(answered, inner=F.try_parse_json("answer.text"))
    stamped = once(
        parsed,
        record=F.when(
            F.expr(is_object("inner")),
            stamp_note("inner", "txt_file", "__date", "texto" if store_text else None, model, prompt_version, remarks, day),
        ),
        usage=usage_struct("body"),
    )
    status = F.expr("coalesce(try_variant_get(v, '$.response.status_code', 'int'), 0)")
    remote = F.expr("try_variant_get(v, '$.error', 'string')")
    has_remote = F.coalesce(remote, F.lit("")).isin("", "false", "0", "{}", "[]") == F.lit(False)
    checks = [
        (F.col("v").isNull(), BAD_JSON, F.lit("line is not JSON")),
        (F.col("__id").isNull(), FAILED, F.concat(F.lit("custom_id not in manifest: "), "custom_id")),
        (has_remote, FAILED, F.concat(F.lit("remote error: "), remote)),
        ((status < 200) | (status >= 300), FAILED, F.concat(F.lit("HTTP "), status.cast("string"))),
        (F.col("answer.error").isNotNull(), FAILED, F.col("answer.error")),
        (F.col("inner").isNull(), BAD_JSON, F.lit("answer is not JSON")),
        (~F.expr(is_object("inner")), FAILED, F.lit("answer is not a JSON object")),
    ]
    if store_text:
        checks.append((F.coalesce("texto", F.lit("")) == "", FAILED, F.lit("full text wanted but the manifest stores none")))
    if schema is not None:
        stamped = once(stamped, broken=F.when(F.col("record").isNotNull(), schema_problem("record", schema)))
        checks.append((F.col("broken").isNotNull(), INVALID, F.concat(F.lit("record breaks the schema: "), "broken")))
    problem = None
    for test, kind, message in checks:
        found = F.struct(F.lit(kind).alias("error_type"), message.alias("error"))
        problem = F.when(test, found) if problem is None else problem.when(test, found)
    return once(stamped, problem=problem).select(
        "custom_id", "line_no", "problem.error_type", "problem.error", "record", "usage", "row_index"
    )


def successes(classified: DataFrame, first: bool = False) -> DataFrame:
    """Successful lines: the last line per id, or the first as the incremental run keeps it."""
    good = classified.where(F.col("error_type").isNull())
    return last_per_key(good, "custom_id", "line_no", first).drop("error_type", "error")


def line_errors(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("error_type").isNotNull()).select("custom_id", "line_no", "error_type", "error")


def missing_outputs(manifest: DataFrame, good: DataFrame) -> DataFrame:
    """Manifest rows without a successful output."""
    return manifest.select("custom_id").join(good.select("custom_id"), "custom_id", "left_anti").select(
        "custom_id", F.lit(MISSING).alias("error_type"), F.lit(MISSING_TEXT).alias("error")
    )


def remote_errors(lines: DataFrame) -> DataFrame:
    return lines.select(F.lit(REMOTE).alias("error_type"), F.to_json("v").alias("raw"))


def errors_union(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def in_manifest_order(good: DataFrame) -> DataFrame:
    return good.orderBy("row_index")


def usage_totals(good: DataFrame) -> DataFrame:
    return good.agg(
        F.count("*").alias("requests_with_usage"), *[F.coalesce(F.sum(f"usage.{u}"), F.lit(0)).alias(u) for u in USAGE]
    )


def usage_per_id(good: DataFrame) -> DataFrame:
    """Usage of every answered id, in manifest order."""
    return good.select("custom_id", "row_index", *[F.col(f"usage.{u}").alias(u) for u in USAGE]).orderBy("row_index")


def ingest_counts(good: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: ``ok, errors, exit_code``."""
    ok = good.agg(F.count("*").alias("ok"))
    return ok.withColumn("errors", errors.agg(F.count("*")).scalar()).withColumn(
        "exit_code", F.when(F.col("errors") == 0, 0).otherwise(2)
    )


def fail_fast(classified: DataFrame) -> DataFrame:
    """The same rows, but the job fails at the first error line."""
    message = F.concat(F.col("error_type"), F.lit(": "), F.col("error"))
    return classified.where(F.when(F.col("error_type").isNotNull(), F.raise_error(message)).otherwise(F.lit(True)))
