"""An annotation corpus derived from the ``documents`` table, in Spark and in SQL.

The operators work on notes with nested event annotations. The given tables hold none, so
the registered queries derive them: every document is a note and every line of its whole text
is an event, whose fields are picked by the digits of the line's md5, or prose, which stands
in the note's title and original text. Lines go into the JSON escaped, as they are. The
same templates are written out as SQL and, for Spark, as a Python function that builds the events
of a note where its text is read; interpreted once per event, the SQL was the dearest step of
every query. Variants:

* ``gold``    complete target records;
* ``pred``    predictions: about half of the events are re-drawn, some are dropped or added,
  some texts are cut off or break the schema;
* ``source``  full records with extra keys, missing keys, odd spellings and wrong types;
* ``expected``  what projecting ``source`` onto the target schema must give.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia import schema as S
from marginalia.session import spread

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(expr: str) -> str:
    return "{{" + expr + "}"


class Sql:
    """How the templates are written as SQL over an event ``e`` whose digest is ``x``."""

    def __init__(self, x: str = "e.h"):
        self.x = x

    def pick(self, values: tuple[str, ...], digit: int) -> str:
        arms = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values))
        return f"CASE {self.code(digit)} % {len(values)} {arms} END"

    def third(self, digit: int) -> str:
        return f"CASE {self.code(digit)} % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END"

    def below(self, digit: int, *cases: tuple[str, str], other: str) -> str:
        arms = " ".join(f"WHEN {self.part(digit, 1)} < '{limit}' THEN {value}" for limit, value in cases)
        return f"CASE {arms} ELSE {other} END"

    def from_two(self, digit: int, yes: str, no: str) -> str:
        return f"CASE WHEN {self.part(digit, 1)} >= '2' THEN {yes} ELSE {no} END"

    def code(self, digit: int) -> str:
        return f"ascii({self.part(digit, 1)})"

    def part(self, start: int, size: int) -> str:
        return f"substr({self.x}, {start}, {size})"

    def text(self, number: str) -> str:
        return f"concat('', {number})"

    def lower(self, value: str) -> str:
        return f"lower({value})"

    def field(self, name: str) -> str:
        return f"e.{name}"

    def rest_is(self, divisor: int, rest: int, yes: str, no: str) -> str:
        return f"CASE WHEN e.d % {divisor} = {rest} THEN {yes} ELSE {no} END"

    def padded(self) -> str:
        return "CASE WHEN e.i < 1000 THEN lpad(concat('', e.i), 3, '0') ELSE concat('', e.i) END"

    def glue(self, *parts: str) -> str:
        """Concatenation; marked parts are expressions, all others JSON text."""
        return "concat(" + ", ".join(p[2:-1] if p.startswith("{{") else "'" + p + "'" for p in parts) + ")"


class Python(Sql):
    """The same as Python source over ``d, i, f, t, h``; what depends on a digit alone is looked up in ``tables``."""

    def __init__(self):
        self.tables: dict[str, dict[str, str]] = {}

    def looked_up(self, digit: int, value: Callable[[str], str]) -> str:
        name = f"T{len(self.tables)}"
        self.tables[name] = {c: value(c) for c in "0123456789abcdef"}
        return f"{name}[h[{digit - 1}]]"

    def pick(self, values: tuple[str, ...], digit: int) -> str:
        return self.looked_up(digit, lambda c: values[ord(c) % len(values)])

    def third(self, digit: int) -> str:
        return self.pick(("true", "false", "null"), digit)

    def below(self, digit: int, *cases: tuple[str, str], other: str) -> str:
        arms = "".join(f"{value} if h[{digit - 1}] < '{limit}' else " for limit, value in cases)
        return f"({arms}{other})"

    def from_two(self, digit: int, yes: str, no: str) -> str:
        return f"({yes} if h[{digit - 1}] >= '2' else {no})"

    def code(self, digit: int) -> str:
        return f"ord(h[{digit - 1}])"

    def part(self, start: int, size: int) -> str:
        return f"h[{start - 1}:{start - 1 + size}]"

    def text(self, number: str) -> str:
        return f"str({number})"

    def lower(self, value: str) -> str:
        return f"{value}.lower()"

    def field(self, name: str) -> str:
        return name if name in "ft" else f"str({name})"

    def rest_is(self, divisor: int, rest: int, yes: str, no: str) -> str:
        # as in SQL, the rest has the sign of the number
        return f"({yes} if d >= 0 and d % {divisor} == {rest} else {no})"

    def padded(self) -> str:
        return "f'{i:03d}'"

    def glue(self, *parts: str) -> str:
        return "''.join((" + ", ".join(p[2:-1] if p.startswith("{{") else repr(p) for p in parts) + ",))"


def _glue(*parts: str) -> str:
    return Sql().glue(*parts)


DETAILS = (
    "delimitacion_evento", "temporalidad", "accion", "sujetos", "demandas", "contra_quien", "lugares", "alcance",
    "cantidad_participantes", "incidentes",
)


def event_json(mode: str = "target", lang: Sql | None = None) -> str:
    """The text that builds one event's JSON, its values picked by the digest; SQL, or as ``lang`` writes it.

    ``mode`` is target, source (odd spellings, extra and missing keys) or expected.
    """
    lang = lang or Sql()
    raw, want = mode == "source", mode == "expected"
    extra = (lambda key: f',"{key}":"r"') if raw else (lambda key: "")
    q = _sql

    def pick(values: tuple[str, ...], digit: int) -> str:
        return q(lang.pick(values, digit))

    def yes_no(digit: int) -> str:
        return pick(S.YES_NO_SD, digit)

    def indicator(name: str, digit: int) -> tuple[str, ...]:
        true_false = q(lang.below(digit, ("8", "'true'"), other="'false'"))
        if raw:
            return (f'"{name}":{{"presencia":', true_false, ',"descripcion":"r","cita_textual":"r","razonamiento":"r"}')
        if want:
            shown = q(lang.below(digit, ("8", "'Sí'"), other="'No'"))
            return (f'"{name}":{{"presencia":"', shown, '","valor_booleano":', true_false, "}")
        value = q(lang.third(digit))
        return (f'"{name}":{{"presencia":"', yes_no(digit), '","valor_booleano":', value, "}")

    def tally(name: str, digit: int) -> tuple[str, ...]:
        value = q(lang.below(digit, ("8", "'null'"), other=lang.text(lang.code(digit))))
        return (f'"{name}":{{"presencia":"', yes_no(digit), '","valor":', value, ',"valor_textual":"S/D"', extra("razonamiento"), "}")

    # odd spellings of a category and what they coerce to
    if raw:
        demand = q(lang.below(27, ("4", "'  GENERO '"), ("8", "'Otra cosa'"), other=lang.pick(S.DEMAND, 27)))
        action = q(lang.below(21, ("6", lang.lower(lang.pick(S.ACTION, 21))), other=lang.pick(S.ACTION, 21)))
    elif want:
        demand = q(lang.below(27, ("4", "'Género'"), ("8", "'S/D'"), other=lang.pick(S.DEMAND, 27)))
        action = pick(S.ACTION, 21)
    else:
        demand, action = pick(S.DEMAND, 27), pick(S.ACTION, 21)

    certainty = '"S/D"' if want else None
    end_date = ('"fecha_fin":{"valor":"S/D"', "}") if raw else (
        ('"fecha_fin":{"valor":"S/D","certeza":', certainty, "}") if want
        else ('"fecha_fin":{"valor":"S/D","certeza":"', pick(S.CERTAINTY, 20), '"}')
    )
    described = "null" if raw else '"S/D"' if want else '"accion"'
    scope = () if raw else (',"alcance":null',) if want else (
        ',"alcance":{"categoria":"', pick(S.SCOPE, 5), '"}')
    details = lang.glue(
        ',"delimitacion_evento":{"descripcion_sintetica":"', q(lang.part(1, 8)),
        '","criterio_delimitacion":"', pick(S.DELIMITATION, 15),
        '","es_accion_principal_con_complementarias":', q(lang.below(16, ("8", "'true'"), other="'false'")),
        ',"cita_textual_evento":"', q(lang.field("t")), '"', extra("razonamiento"),
        '},"temporalidad":{"tipo_temporal":"', pick(S.TIME_KIND, 17), '","tempo_verbal":"', pick(S.TENSE, 18),
        '","fecha_inicio":{"valor":"', q(lang.field("f")), '","certeza":"', pick(S.CERTAINTY, 19), '"', extra("cita_textual"),
        "},", *end_date, ',"expresion_temporal_textual":"","fecha_publicacion_usada_como_referencia":"', q(lang.field("f")), '"',
        extra("razonamiento"),
        f'}},"accion":{{"descripcion_textual":{described},"formato_principal":{{"valor_textual":"',
        q(lang.part(21, 4)), '","categoria":"', action, '"', extra("subtipo_textual"),
        '},"formatos_complementarios":[',
        q(lang.below(22, ("6", "''"), other=lang.glue('{"valor_textual":"a","categoria":"', pick(S.ACTION, 23), '"}'))),
        "]", extra("razonamiento"),
        '},"sujetos":[{"sujeto_id":"s1","nombre_textual":"', q(lang.part(24, 3)), '","categoria":"',
        pick(S.SUBJECT, 24), '"', extra("cita_textual"),
        ',"organizaciones":[{"organizacion_id":"o1","nombre_textual":"o","categoria":"', pick(S.ORGANISATION, 25), '"}]}',
        q(lang.below(26, ("8", "''"), other=lang.glue(
            ',{"sujeto_id":"s2","nombre_textual":"","categoria":"', pick(S.SUBJECT, 26),
            '","organizaciones":[{"organizacion_id":"o2","nombre_textual":"o","categoria":"', pick(S.ORGANISATION, 12),
            '"},{"organizacion_id":"o3","nombre_textual":"o","categoria":"Civil"}]}'))),
        '],"demandas":[{"demanda_id":"d1","descripcion_textual":"', q(lang.part(27, 2)), '","categoria":"', demand,
        '","dirigida_a_contra_ids":["c1"', q(lang.below(28, ("8", "''"), other="',\"c2\"'")), "]", extra("motivo_ids"),
        '}],"contra_quien":[{"contra_id":"c1","nombre_textual":"c","categoria":"', pick(S.OPPONENT, 29),
        '","nivel_institucional":"', pick(S.LEVEL, 30), '"', extra("razonamiento"), '}],"lugares":',
        q(lang.below(31, ("2", "'null'"), other=lang.glue(
            '[{"lugar_id":"l1","nombre_textual":"l","categoria":"', pick(S.PLACE, 31), '","rol_en_evento":"',
            pick(S.PLACE_ROLE, 32), '","localidad":"x","provincia":"","pais":"AR","direccion_o_referencia":"S/D"}]'))),
        *scope,
        ',"cantidad_participantes":{"hay_cantidad_mencionada":"', yes_no(6), '","valor":',
        q(lang.below(7, ("8", "'null'"), other=lang.text(f"{lang.code(7)} * 10"))),
        ',"valor_textual":"S/D","es_aproximada":"', yes_no(8), '"', extra("fuente_de_la_cifra"), '},"incidentes":{',
        *indicator("represion", 9), ",", *indicator("enfrentamiento", 10), ",", *tally("detenidos", 11), ",",
        *tally("heridos", 12), ",", *tally("muertos", 13), ",", *indicator("danios_materiales", 14), "}",
    )
    nothing = "".join(f',"{key}":null' for key in DETAILS)
    not_event = f"'{nothing}'"
    if raw:
        # a tenth of the notes carry a list where null is due, empty or not
        filled = '[{"sujeto_id":"s9","otros":["x",null,{"a":1,"b":["y",false,"z","w","v"]}]}]'
        subjects = lang.glue(',"sujetos":', q(lang.rest_is(20, 8, "'[]'", f"'{filled}'")), ',"accion":null')
        not_event = lang.rest_is(10, 8, subjects, f"'{nothing}'")
    number = q(lang.field("i"))
    if raw or want:
        # a few notes carry a number as text, which no coercion repairs
        number = q(lang.rest_is(17, 5, lang.glue('"', q(lang.field("i")), '"'), lang.text("e.i" if type(lang) is Sql else "i")))
    tail = lang.glue(',"observaciones_evento":"r","motivos":[{"motivo_id":"m1","texto":"t"},{"motivo_id":null,"si":true}],'
                   '"individuos_nombrados":{"hay_individuos_nombrados":"No","personas":[]},'
                   '"voces_protagonistas":{"hay_voces_protagonistas":"Sí","citas":["a","b"]},'
                   '"control_extraccion":{"campos_inferidos":["x"],"requiere_revision_humana":false}') if raw else "''"
    return lang.glue(
        '{"evento_id":"doc_', q(lang.field("d")), "__evento_", q(lang.padded()),
        '","evento_numero":', number, ',"es_evento_protesta":',
        q(lang.from_two(14, "'true'", "'false'")),
        q(lang.from_two(14, details, not_event)),
        q(lang.from_two(14, tail, "''")), "}",
    )


def note_json(mode: str = "target") -> str:
    """SQL text of a whole note's JSON over ``doc_id``, ``fecha``, ``n`` and ``body``."""
    q = _sql
    # some source notes carry a date the schema's pattern refuses
    dated = q("CASE WHEN doc_id % 23 = 6 THEN concat(substr(fecha, 7, 4), '-', substr(fecha, 4, 2), '-', substr(fecha, 1, 2)) ELSE fecha END")
    if mode == "target":
        head = ('{"schema_version":"1.0.0","nota":{"nota_id":"doc_', q("doc_id"), '","fecha_publicacion":"', q("fecha"),
                '","titulo":"t', q("doc_id % 5"), " ", q("prose"), '"}')
    elif mode == "expected":
        head = ('{"schema_version":"1.0.0","nota":{"nota_id":"doc_', q("doc_id"), '","fecha_publicacion":"', dated,
                '","titulo":"', q("CASE WHEN doc_id % 4 = 1 THEN 'S/D' ELSE concat('t', doc_id % 5) END"), '"}')
    else:
        reviewed = ('CASE doc_id % 3 WHEN 0 THEN \'\' WHEN 1 THEN \',"validacion_humana":{"modificada":true,'
                    '"usuario_validador":"","fecha_revision":"2026-01-02","observaciones":null,"tags_topicos":["a","b"]}\' '
                    'ELSE \',"validacion_humana":{"modificada":false,"usuario_validador":"u","tags_topicos":[]}\' END')
        head = ('{"schema_version":"1.1.0","codebook_version":"c1","nota":{"nota_id":"doc_', q("doc_id"),
                '","archivo_fuente":"doc_', q("doc_id"), '","fuente":"f","subtitulo":"s","texto_original":"', q("prose"),
                '","fecha_publicacion":"', dated, '","titulo":',
                q("CASE WHEN doc_id % 4 = 1 THEN 'null' ELSE concat('\"t', doc_id % 5, '\"') END"),
                '},"metadatos_extraccion":{"modelo":"m","estado_validacion_humana":"No validado"}', q(reviewed))
    stated = q("CASE WHEN doc_id % 10 = 9 THEN n + 1 ELSE n END") if mode != "target" else q("n")
    tail = ',"observaciones_extraccion":"r"' if mode == "source" else ""
    return _glue(
        *head, ',"extraccion":{"tiene_eventos_protesta":', q("CASE WHEN n > 0 THEN 'true' ELSE 'false' END"),
        ',"total_eventos_protesta":', stated, ',"eventos_protesta":[', q("body"), "]", tail, "}}",
    )


# --- Spark side ---------------------------------------------------------------------

MUTATED = "CASE WHEN substr(e.h, 1, 1) < '8' THEN e.h ELSE concat(substr(e.h, 1, 12), substr(md5(concat(e.t, '#')), 13, 20)) END"


def is_event_line(line: Column) -> Column:
    """Whether a line is an event; a blank line is prose, and of the others a quarter by their digest, so that some notes have no event."""
    return (F.trim(line) != "") & (F.substring(F.md5(line), 20, 1) >= "4")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: ``doc_id, fecha`` and ``texto``, the lines that are no events."""
    prose = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_event_line(x)), "\n")
    return _dated(spark, sf_dir).select("doc_id", "fecha", prose.alias("texto"))


#: What JSON escapes within a string.
ESCAPES = {chr(c): f"\\u{c:04X}" for c in range(32)} | {
    '"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
ESCAPED = re.compile(r'[\x00-\x1f"\\]')
#: Characters of one output batch, give or take a note.
BATCH_CHARS = 16_000_000


def _bodies(mode: str, redrawn: bool):
    """Batches of ``doc_id, fecha, text`` as ``doc_id, fecha, n, prose, body``; with ``redrawn`` the events are those of a prediction."""
    lang = Python()
    source, tables = f"lambda d, i, f, t, h: {event_json(mode, lang)}", lang.tables

    def escape(text: str) -> str:
        return ESCAPED.sub(lambda m: ESCAPES[m.group()], text)

    def digest(text: bytes) -> str:
        return hashlib.md5(text, usedforsecurity=False).hexdigest()

    def note(event: Callable[..., str], d: int | None, f: str | None, text: bytes | None) -> tuple:
        if d is None or text is None:
            return None, None, None
        events, prose = [], []
        for line in text.split(b"\n"):
            h = digest(line)
            if h[19] >= "4" and line.strip(b" "):
                t = escape(line.decode(errors="replace"))
                if redrawn and h[0] >= "8":
                    h = h[:12] + digest(t.encode() + b"#")[12:]
                events.append(event(d, len(events) + 1, f, t, h))
            else:
                prose.append(line)
        if redrawn and events:
            events = events[:-1] if d % 5 == 0 else events + events[:1] if d % 7 == 0 else events
        return len(events), escape(b"\n".join(prose).decode(errors="replace")), ",".join(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event = eval(source, dict(tables))
        types = (pa.int32(), pa.string(), pa.string())
        for batch in batches:
            ids, dates, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            begun, out, size = 0, [], 0
            for k in range(batch.num_rows):
                out.append(note(event, ids[k].as_py(), dates[k].as_py(), texts[k].as_py()))
                size += len(out[-1][1] or "") + len(out[-1][2] or "")
                if size >= BATCH_CHARS or k + 1 == batch.num_rows:
                    kept = [ids.slice(begun, len(out)), dates.slice(begun, len(out))]
                    made = [pa.array(column, t) for column, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(kept + made, names=["doc_id", "fecha", "n", "prose", "body"])
                    begun, out, size = k + 1, [], 0

    return run


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("date_add(DATE '1990-01-01', CAST(doc_id * 37 % 730 AS INT))")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.date_format(day, "dd/MM/yyyy").alias("fecha"), "text")


def _render(notes: DataFrame, mode: str, name: str, redrawn: bool = False) -> DataFrame:
    """``doc_id`` and the JSON of its note."""
    spec = f"doc_id {notes.schema['doc_id'].dataType.simpleString()}, fecha string, n int, prose string, body string"
    return notes.mapInArrow(_bodies(mode, redrawn), spec).select("doc_id", F.expr(note_json(mode)).alias(name))


def gold_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, nota_id, gold_json``: complete target records."""
    df = _render(_dated(spark, sf_dir), "target", "gold_json")
    return df.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("nota_id"), "gold_json")


def pred_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, nota_id, raw_text, finish_reason, prompt_tokens, output_tokens``."""
    df = _render(_dated(spark, sf_dir), "target", "whole", redrawn=True)
    return df.select(
        "doc_id",
        F.concat(F.lit("doc_"), "doc_id").alias("nota_id"),
        F.expr(
            "CASE WHEN doc_id % 11 = 3 THEN substr(whole, 1, length(whole) - 5) WHEN doc_id % 13 = 4 "
            "THEN replace(whole, '\"titulo\"', '\"otro\"') ELSE whole END"
        ).alias("raw_text"),
        F.expr("CASE WHEN doc_id % 11 = 3 THEN 'length' ELSE 'stop' END").alias("finish_reason"),
        F.expr("(doc_id * 131) % 22000").alias("prompt_tokens"),
        F.expr("CAST(ceil(length(whole) / 4) AS BIGINT)").alias("output_tokens"),
    )


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, nota_id, source_json``: full records as they come from annotation."""
    df = _render(_dated(spark, sf_dir), "source", "source_json")
    return df.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("nota_id"), "source_json")


# --- SQL side -----------------------------------------------------------------------

LINES_SQL = r"""
lines AS MATERIALIZED (
  SELECT doc_id, fecha, lines, texto, substr(CAST(to_json(texto) AS VARCHAR), 2, length(CAST(to_json(texto) AS VARCHAR)) - 2) AS prose FROM (
    SELECT doc_id, fecha, array_to_string(list_filter(string_split(text, chr(10)),
        lambda x: NOT (trim(x) <> '' AND substr(md5(x), 20, 1) >= '4')), chr(10)) AS texto, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND substr(md5(x), 20, 1) >= '4'),
      lambda x, j: struct_pack(d := doc_id, i := j, f := fecha,
        t := substr(CAST(to_json(x) AS VARCHAR), 2, length(CAST(to_json(x) AS VARCHAR)) - 2), h := md5(x))) AS lines
    FROM (SELECT doc_id, text, strftime(DATE '1990-01-01' + CAST(doc_id * 37 % 730 AS INTEGER), '%d/%m/%Y') AS fecha
          FROM documents))
)"""


def _note_cte(name: str, column: str, event: str, note: str, source: str = "lines") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT doc_id, concat('doc_', doc_id) AS nota_id, {note} AS {column} FROM (
    SELECT *, len(lines) AS n, array_to_string(list_transform(lines, lambda e: {event}), ',') AS body FROM {source})
)"""


GOLD_SQL = _note_cte("gold", "gold_json", event_json(), note_json())
PRED_SQL = (
    "\nmutated AS (SELECT doc_id, fecha, prose, CASE WHEN doc_id % 5 = 0 AND len(l) > 0 THEN list_slice(l, 1, len(l) - 1) "
    "WHEN doc_id % 7 = 0 AND len(l) > 0 THEN list_concat(l, list_slice(l, 1, 1)) ELSE l END AS lines FROM ("
    "SELECT doc_id, fecha, prose, list_transform(lines, lambda e: struct_pack(d := e.d, i := e.i, f := e.f, t := e.t, "
    f"h := {MUTATED})) AS l FROM lines)),"
    + _note_cte("whole_pred", "whole", event_json(), note_json(), "mutated")
    + """,
pred AS MATERIALIZED (
  SELECT doc_id, nota_id,
    CASE WHEN doc_id % 11 = 3 THEN substr(whole, 1, length(whole) - 5)
         WHEN doc_id % 13 = 4 THEN replace(whole, '"titulo"', '"otro"') ELSE whole END AS raw_text,
    CASE WHEN doc_id % 11 = 3 THEN 'length' ELSE 'stop' END AS finish_reason,
    (doc_id * 131) % 22000 AS prompt_tokens, CAST(ceil(length(whole) / 4.0) AS BIGINT) AS output_tokens,
    doc_id % 11 <> 3 AS parse_valid, doc_id % 11 <> 3 AND doc_id % 13 <> 4 AS schema_valid
  FROM whole_pred
)"""
)
SOURCE_SQL = _note_cte("source", "source_json", event_json("source"), note_json("source"))
EXPECTED_SQL = _note_cte("expected", "expected_json", event_json("expected"), note_json("expected"))


def with_notes(*parts: str) -> str:
    """``WITH`` clause deriving the named corpus tables."""
    return "WITH " + ",".join((LINES_SQL,) + parts)
