"""Flat export: one row per event, the note part repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.render import list_at, list_cells, review_editor, review_status, review_tags, scalar_at
from marginalia.schema import Node, listing, text
from marginalia.session import once

# Column names of the flat table and the paths they show.
NOTE_COLUMNS = (
    ("schema_version", "schema_version"),
    ("codebook_version", "codebook_version"),
    ("nota_id", "nota.nota_id"),
    ("nota_archivo_fuente", "nota.archivo_fuente"),
    ("nota_fuente", "nota.fuente"),
    ("nota_fecha_publicacion", "nota.fecha_publicacion"),
    ("nota_titulo", "nota.titulo"),
    ("nota_subtitulo", "nota.subtitulo"),
    ("texto_original", "nota.texto_original"),
    *[(f"meta_{k}", f"metadatos_extraccion.{k}") for k in (
        "modelo", "proveedor", "fecha_extraccion", "prompt_version", "extractor_tipo", "modo_procesamiento",
        "estado_validacion_humana", "observaciones_metodologicas", "codebook_version")],
    ("tiene_eventos_protesta", "extraccion.tiene_eventos_protesta"),
    ("total_eventos_protesta", "extraccion.total_eventos_protesta"),
    ("extraccion_observaciones_extraccion", "extraccion.observaciones_extraccion"),
)
REVIEW_COLUMNS = tuple((f"validacion_{k}", f"validacion_humana.{k}") for k in (
    "modificada", "usuario_validador", "fecha_revision", "observaciones"))
_DATED = ("valor", "tipo_inferencia", "cita_textual", "razonamiento")
_SEEN = ("presencia", "descripcion", "cita_textual", "razonamiento")
_COUNTED = ("presencia", "valor", "valor_textual", "cita_textual", "razonamiento")
EVENT_COLUMNS = (
    ("evento_id", "evento_id"),
    ("evento_numero", "evento_numero"),
    ("es_evento_protesta", "es_evento_protesta"),
    ("observaciones_evento", "observaciones_evento"),
    *[(f"delim_{k}", f"delimitacion_evento.{k}") for k in (
        "descripcion_sintetica", "criterio_delimitacion", "es_accion_principal_con_complementarias",
        "cita_textual_evento", "razonamiento")],
    ("tipo_temporal", "temporalidad.tipo_temporal"),
    ("tempo_verbal", "temporalidad.tempo_verbal"),
    *[(f"{d}_{k}", f"temporalidad.{d}.{k}") for d in ("fecha_inicio", "fecha_fin") for k in _DATED],
    ("expresion_temporal_textual", "temporalidad.expresion_temporal_textual"),
    ("fecha_publicacion_usada_como_referencia", "temporalidad.fecha_publicacion_usada_como_referencia"),
    ("temporalidad_razonamiento", "temporalidad.razonamiento"),
    ("accion_descripcion_textual", "accion.descripcion_textual"),
    ("accion_formato_principal_cita_textual", "accion.formato_principal.cita_textual"),
    ("accion_valor_textual", "accion.formato_principal.valor_textual"),
    ("accion_categoria", "accion.formato_principal.categoria"),
    ("accion_formato_principal_subtipo_textual", "accion.formato_principal.subtipo_textual"),
    ("accion_formato_principal_razonamiento", "accion.formato_principal.razonamiento"),
    ("accion_formatos_complementarios", "accion.formatos_complementarios[]"),
    ("accion_razonamiento", "accion.razonamiento"),
    *[(k, f"{k}[]") for k in ("sujetos", "motivos", "demandas", "contra_quien", "lugares")],
    *[(f"alcance_{k}", f"alcance.{k}") for k in ("categoria", "cita_textual", "razonamiento")],
    ("cantidad_hay_mencionada", "cantidad_participantes.hay_cantidad_mencionada"),
    *[(f"cantidad_{k}", f"cantidad_participantes.{k}") for k in (
        "valor", "valor_textual", "es_aproximada", "cita_textual", "fuente_de_la_cifra", "razonamiento")],
    *[(f"incidentes_{i}_{k}", f"incidentes.{i}.{k}") for i in ("represion", "enfrentamiento") for k in _SEEN],
    *[(f"incidentes_{i}_{k}", f"incidentes.{i}.{k}") for i in ("detenidos", "heridos", "muertos") for k in _COUNTED],
    ("individuos_hay_nombrados", "individuos_nombrados.hay_individuos_nombrados"),
    ("individuos_personas", "individuos_nombrados.personas[]"),
    ("voces_hay_protagonistas", "voces_protagonistas.hay_voces_protagonistas"),
    ("voces_citas", "voces_protagonistas.citas[]"),
    ("control_campos_inferidos", "control_extraccion.campos_inferidos[]"),
    ("control_ambiguedades", "control_extraccion.ambiguedades[]"),
    ("control_advertencias_atomicidad", "control_extraccion.advertencias_atomicidad[]"),
    ("control_requiere_revision_humana", "control_extraccion.requiere_revision_humana"),
    ("control_razones_revision", "control_extraccion.razones_revision[]"),
)


def explode_events(notes: DataFrame, value: str, event: str = "event") -> DataFrame:
    """One row per event; a note without events gives one row with a null event. Narrow."""
    events = F.expr(f"try_variant_get({value}, '$.extraccion.eventos_protesta', 'array<variant>')")
    return notes.select("*", F.explode_outer(events).alias(event))


def _fields(*names: str, **lists: Node) -> Node:
    return Node("object", props={name: lists.get(name, text()) for name in names})


#: Declared keys of the records in list columns, in order; other keys follow them.
LISTS = {
    "accion.formatos_complementarios": _fields("cita_textual", "valor_textual", "categoria", "subtipo_textual", "razonamiento"),
    "sujetos": _fields("sujeto_id", "nombre_textual", "categoria", "cita_textual", "organizaciones", organizaciones=listing(
        _fields("organizacion_id", "nombre_textual", "categoria", "cita_textual", "razonamiento"))),
    "motivos": _fields("motivo_id", "texto"),
    "demandas": _fields("demanda_id", "descripcion_textual", "categoria", "dirigida_a_contra_ids", "motivo_ids",
                        dirigida_a_contra_ids=listing(text()), motivo_ids=listing(text())),
    "contra_quien": _fields("contra_id", "nombre_textual", "categoria", "nivel_institucional", "cita_textual", "razonamiento"),
    "lugares": _fields("lugar_id", "nombre_textual", "categoria", "rol_en_evento", "localidad", "provincia", "pais", "direccion_o_referencia"),
}


def _cell(variant: str, path: str) -> Column:
    if path.endswith("[]"):
        return list_at(variant, path[:-2], LISTS.get(path[:-2]))
    return scalar_at(variant, path)


def wide_columns(note: str, event: str) -> list[Column]:
    """All columns of the flat table, in order."""
    head = [_cell(note, path).alias(name) for name, path in NOTE_COLUMNS]
    review = [
        review_status(note).alias("estado_validacion_humana"), review_tags(note).alias("tags_topicos"),
        review_editor(note).alias("modificado_por"),
    ]
    review += [_cell(note, path).alias(name) for name, path in REVIEW_COLUMNS]
    return head + review + [_cell(event, path).alias(name) for name, path in EVENT_COLUMNS]


def wide_projection(notes: DataFrame, value: str) -> DataFrame:
    """The flat table of parsed notes; the note part is rendered once, before the events multiply it."""
    note_part = wide_columns(value, "event")[: len(NOTE_COLUMNS) + 3 + len(REVIEW_COLUMNS)]
    rendered = once(notes.select(value), head=F.struct(*note_part))
    listed = {name: path[:-2] for name, path in EVENT_COLUMNS if path.endswith("[]")}
    events = explode_events(rendered, value).select("head", "event")
    events = once(events, lists=list_cells(F.col("event"), listed, LISTS))
    return events.select("head.*", *[F.col(f"lists.{n}") if n in listed else _cell("event", p).alias(n) for n, p in EVENT_COLUMNS])
