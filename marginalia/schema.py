"""Record schemas as small trees: read from JSON Schema, turned into Spark types and rules.

A schema is a driver-side object of a few hundred nodes at most. Operators walk it once
to build column expressions; rows are never walked in Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Iterator

from pyspark.sql import DataFrame, SparkSession, types as T

SD = "S/D"
YES_NO_SD = ("Sí", "No", "S/D")


@dataclass(frozen=True)
class Node:
    """One schema node. ``kind`` is object, array, string, integer, number or boolean."""

    kind: str
    nullable: bool = False
    props: dict[str, "Node"] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    closed: bool = False
    item: "Node | None" = None
    enum: tuple[str, ...] = ()
    const: Any = None
    pattern: str | None = None
    minimum: int | None = None
    min_items: int | None = None

    @property
    def is_container(self) -> bool:
        return self.kind in ("object", "array")


def from_json_schema(doc: dict[str, Any]) -> Node:
    """Read a Draft 2020-12 document that uses only local references."""

    def build(part: dict[str, Any]) -> Node:
        ref = part.get("$ref")
        if ref:
            if not ref.startswith("#/"):
                raise ValueError(f"only local references are supported: {ref}")
            target: Any = doc
            for step in ref[2:].split("/"):
                target = target[step]
            return build(target)
        declared = part.get("type", "object")
        names = declared if isinstance(declared, list) else [declared]
        return Node(
            kind=next(n for n in names if n != "null"),
            nullable="null" in names,
            props={k: build(v) for k, v in part.get("properties", {}).items()},
            required=tuple(part.get("required", ())),
            closed=part.get("additionalProperties") is False,
            item=build(part["items"]) if "items" in part else None,
            enum=tuple(part.get("enum", ())),
            const=part.get("const"),
            pattern=part.get("pattern"),
            minimum=part.get("minimum"),
            min_items=part.get("minItems"),
        )

    return build(doc)


def spark_type(node: Node) -> T.DataType:
    """Spark type of a schema-valid value."""
    if node.kind == "object":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in node.props.items()])
    if node.kind == "array":
        return T.ArrayType(spark_type(node.item))
    return {
        "string": T.StringType(),
        "integer": T.LongType(),
        "number": T.DoubleType(),
        "boolean": T.BooleanType(),
    }[node.kind]


def ddl(node: Node) -> str:
    return spark_type(node).simpleString()


def escape_pointer(key: str) -> str:
    """JSON pointer escape of one key."""
    return key.replace("~", "~0").replace("/", "~1")


def walk_schema(node: Node, pointer: str = "") -> Iterator[tuple[str, Node]]:
    """All nodes with their pointer; array items are written ``*``."""
    yield pointer, node
    for key, child in node.props.items():
        yield from walk_schema(child, f"{pointer}/{escape_pointer(key)}")
    if node.item is not None:
        yield from walk_schema(node.item, f"{pointer}/*")


def required_paths(node: Node, pointer: str = "") -> list[str]:
    """Pointers of all required keys, parents before children."""
    found: list[str] = []
    for key in node.required:
        child = f"{pointer}/{escape_pointer(key)}"
        found.append(child)
        if key in node.props:
            found += required_paths(node.props[key], child)
    if node.item is not None:
        found += required_paths(node.item, f"{pointer}/*")
    return found


RULE_TYPE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("enum_values", T.ArrayType(T.StringType())),
        T.StructField("const_value", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("minimum", T.LongType()),
        T.StructField("min_items", T.IntegerType()),
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("known_keys", T.ArrayType(T.StringType())),
        T.StructField("closed", T.BooleanType()),
    ]
)


def rule_rows(node: Node) -> list[tuple]:
    return [
        (
            path,
            [n.kind] + (["null"] if n.nullable else []),
            list(n.enum) or None,
            n.const,
            n.pattern,
            n.minimum,
            n.min_items,
            list(n.required),
            list(n.props),
            n.closed,
        )
        for path, n in walk_schema(node)
    ]


def rule_table(spark: SparkSession, node: Node) -> DataFrame:
    """One row per schema node. Its size is the size of the schema, never of the data."""
    return spark.createDataFrame(rule_rows(node), RULE_TYPE)


# --- small builders for writing a schema in code ------------------------------------


def text(pattern: str | None = None) -> Node:
    return Node("string", pattern=pattern)


def choice(*values: str) -> Node:
    return Node("string", enum=values)


def whole(minimum: int | None = None, nullable: bool = False) -> Node:
    return Node("integer", nullable=nullable, minimum=minimum)


def flag(nullable: bool = False) -> Node:
    return Node("boolean", nullable=nullable)


def record(nullable: bool = False, **props: Node) -> Node:
    return Node("object", nullable=nullable, props=props, required=tuple(props), closed=True)


def listing(item: Node, min_items: int | None = None, nullable: bool = False) -> Node:
    return Node("array", nullable=nullable, item=item, min_items=min_items)


# --- the target annotation schema ---------------------------------------------------
# Names, categories, date pattern and limits of the annotation scheme.

DATE_PATTERN = r"^(S/D|\d{2}/\d{2}/\d{4})$"

ACTION = (
    "Acciones judiciales", "Asambleas", "Ataques", "Cortes", "Huelgas", "Manifestaciones",
    "Manifestaciones de baja intensidad", "Ocupaciones", "Reuniones entre las partes litigantes",
    "Residuales", "S/D",
)
SUBJECT = (
    "Asalariados", "Comunidad educativa", "Empresarios / Gerentes / Directivos", "Estudiantes",
    "Familiares", "Militantes", "Militares", "Profesionales", "Pobres", "Vecinos", "Residual", "S/D",
)
ORGANISATION = (
    "Ambientalista", "Civil", "Cooperativa de Trabajo", "Estatal", "Estudiantil", "Género", "Militar",
    "Patronal", "Política", "Profesional", "Religiosa", "Sindical", "Tercera edad", "Territorial",
    "Vecinal", "Residual", "S/D",
)
DEMAND = (
    "Ambiental", "Bienestar estudiantil", "Condiciones de vida", "Económica", "Género",
    "Infraestructura", "Laboral", "Política", "Salarial", "Gremial (Inter-intra sindical)",
    "Seguridad", "Residual", "S/D",
)
OPPONENT = ("Delito", "Estado/Gobierno", "Patronal", "Sindicatos", "Residual", "S/D")
PLACE = (
    "Vía pública", "Instituciones públicas", "Sede patronal", "Lugar de Trabajo", "Sede sindical", "S/D",
)
DELIMITATION = (
    "Temporal", "Espacial", "Temporal y espacial", "Accion principal con acciones complementarias",
    "Evento unico en la nota", "S/D",
)
CERTAINTY = ("Exacta", "Relativa calculada", "Aproximada", "S/D")
LEVEL = ("Municipal", "Provincial", "Nacional", "Internacional", "Privado", "No aplica", "S/D")
PLACE_ROLE = ("Lugar principal", "Inicio", "Recorrido", "Destino", "Lugar complementario", "S/D")
SCOPE = ("Local", "Provincial", "Nacional", "Internacional", "S/D")
TIME_KIND = ("Hecho", "Anuncio", "S/D")
TENSE = ("Pasado", "Presente", "Futuro", "S/D")

CORE_EVENT_FIELDS = ("evento_id", "evento_numero", "es_evento_protesta")
FORBIDDEN_KEYS = (
    "texto_original", "subtitulo", "fuente", "archivo_fuente", "codebook_version",
    "metadatos_extraccion", "validacion_humana", "calidad_extraccion", "observaciones_extraccion",
    "voces_protagonistas", "personas_mencionadas", "fuente_de_la_cifra",
)
FORBIDDEN_PREFIX = "razonamiento_"


def _dated() -> Node:
    return record(valor=text(DATE_PATTERN), certeza=choice(*CERTAINTY))


def _format() -> Node:
    return record(valor_textual=text(), categoria=choice(*ACTION))


def _indicator() -> Node:
    return record(presencia=choice(*YES_NO_SD), valor_booleano=flag(nullable=True))


def _tally() -> Node:
    return record(presencia=choice(*YES_NO_SD), valor=whole(0, nullable=True), valor_textual=text())


def target_event() -> Node:
    return record(
        evento_id=text(),
        evento_numero=whole(1),
        es_evento_protesta=flag(),
        delimitacion_evento=record(
            nullable=True,
            descripcion_sintetica=text(),
            criterio_delimitacion=choice(*DELIMITATION),
            es_accion_principal_con_complementarias=flag(),
            cita_textual_evento=text(),
        ),
        temporalidad=record(
            nullable=True,
            tipo_temporal=choice(*TIME_KIND),
            tempo_verbal=choice(*TENSE),
            fecha_inicio=_dated(),
            fecha_fin=_dated(),
            expresion_temporal_textual=text(),
            fecha_publicacion_usada_como_referencia=text(DATE_PATTERN),
        ),
        accion=record(
            nullable=True,
            descripcion_textual=text(),
            formato_principal=_format(),
            formatos_complementarios=listing(_format()),
        ),
        sujetos=listing(
            record(
                sujeto_id=text(),
                nombre_textual=text(),
                categoria=choice(*SUBJECT),
                organizaciones=listing(
                    record(organizacion_id=text(), nombre_textual=text(), categoria=choice(*ORGANISATION)), 1
                ),
            ),
            1,
            nullable=True,
        ),
        demandas=listing(
            record(
                demanda_id=text(),
                descripcion_textual=text(),
                categoria=choice(*DEMAND),
                dirigida_a_contra_ids=listing(text(), 1),
            ),
            1,
            nullable=True,
        ),
        contra_quien=listing(
            record(
                contra_id=text(),
                nombre_textual=text(),
                categoria=choice(*OPPONENT),
                nivel_institucional=choice(*LEVEL),
            ),
            1,
            nullable=True,
        ),
        lugares=listing(
            record(
                lugar_id=text(),
                nombre_textual=text(),
                categoria=choice(*PLACE),
                rol_en_evento=choice(*PLACE_ROLE),
                localidad=text(),
                provincia=text(),
                pais=text(),
                direccion_o_referencia=text(),
            ),
            1,
            nullable=True,
        ),
        alcance=record(nullable=True, categoria=choice(*SCOPE)),
        cantidad_participantes=record(
            nullable=True,
            hay_cantidad_mencionada=choice(*YES_NO_SD),
            valor=whole(0, nullable=True),
            valor_textual=text(),
            es_aproximada=choice(*YES_NO_SD),
        ),
        incidentes=record(
            nullable=True,
            represion=_indicator(),
            enfrentamiento=_indicator(),
            detenidos=_tally(),
            heridos=_tally(),
            muertos=_tally(),
            danios_materiales=_indicator(),
        ),
    )


def target_schema() -> Node:
    return record(
        schema_version=Node("string", const="1.0.0"),
        nota=record(nota_id=text(), fecha_publicacion=text(DATE_PATTERN), titulo=text()),
        extraccion=record(
            tiene_eventos_protesta=flag(),
            total_eventos_protesta=whole(0),
            eventos_protesta=listing(target_event()),
        ),
    )


TARGET = target_schema()

HEADLINE_PATH = "extraccion.tiene_eventos_protesta"
TOTAL_PATH = "extraccion.total_eventos_protesta"
EVENTS = "extraccion.eventos_protesta[]."
# Scored paths of an event in report order, as label and path.
SCORED_PATHS = (
    ("evento.es_evento_protesta", "extraccion.eventos_protesta[].es_evento_protesta"),
    ("delimitacion.criterio_delimitacion", "extraccion.eventos_protesta[].delimitacion_evento.criterio_delimitacion"),
    ("delimitacion.es_accion_principal_con_complementarias", "extraccion.eventos_protesta[].delimitacion_evento.es_accion_principal_con_complementarias"),
    ("temporalidad.tipo_temporal", "extraccion.eventos_protesta[].temporalidad.tipo_temporal"),
    ("temporalidad.tempo_verbal", "extraccion.eventos_protesta[].temporalidad.tempo_verbal"),
    ("temporalidad.fecha_inicio.certeza", "extraccion.eventos_protesta[].temporalidad.fecha_inicio.certeza"),
    ("temporalidad.fecha_fin.certeza", "extraccion.eventos_protesta[].temporalidad.fecha_fin.certeza"),
    ("accion.formato_principal.categoria", "extraccion.eventos_protesta[].accion.formato_principal.categoria"),
    ("sujetos[].categoria", "extraccion.eventos_protesta[].sujetos[].categoria"),
    ("sujetos[].organizaciones[].categoria", "extraccion.eventos_protesta[].sujetos[].organizaciones[].categoria"),
    ("demandas[].categoria", "extraccion.eventos_protesta[].demandas[].categoria"),
    ("contra_quien[].categoria", "extraccion.eventos_protesta[].contra_quien[].categoria"),
    ("contra_quien[].nivel_institucional", "extraccion.eventos_protesta[].contra_quien[].nivel_institucional"),
    ("lugares[].categoria", "extraccion.eventos_protesta[].lugares[].categoria"),
    ("lugares[].rol_en_evento", "extraccion.eventos_protesta[].lugares[].rol_en_evento"),
    ("alcance.categoria", "extraccion.eventos_protesta[].alcance.categoria"),
    ("cantidad_participantes.hay_cantidad_mencionada", "extraccion.eventos_protesta[].cantidad_participantes.hay_cantidad_mencionada"),
    ("cantidad_participantes.es_aproximada", "extraccion.eventos_protesta[].cantidad_participantes.es_aproximada"),
    ("incidentes.represion.presencia", "extraccion.eventos_protesta[].incidentes.represion.presencia"),
    ("incidentes.enfrentamiento.presencia", "extraccion.eventos_protesta[].incidentes.enfrentamiento.presencia"),
    ("incidentes.detenidos.presencia", "extraccion.eventos_protesta[].incidentes.detenidos.presencia"),
    ("incidentes.heridos.presencia", "extraccion.eventos_protesta[].incidentes.heridos.presencia"),
    ("incidentes.muertos.presencia", "extraccion.eventos_protesta[].incidentes.muertos.presencia"),
    ("incidentes.danios_materiales.presencia", "extraccion.eventos_protesta[].incidentes.danios_materiales.presencia"),
)
