"""Metric arithmetic, rankings and run statuses on fixed numbers."""

from pyspark.sql import functions as F

from marginalia.operators import errors as E, score as S
from marginalia.schema import HEADLINE_PATH

# Published counts per path (tp, tn, fp, fn), best ranked first.
COUNTS = [
    ("demandas[].categoria", 16, 0, 45, 32), ("accion.formato_principal.categoria", 13, 0, 32, 25),
    ("delimitacion.criterio_delimitacion", 14, 0, 31, 24), ("sujetos[].organizaciones[].categoria", 22, 0, 42, 29),
    ("contra_quien[].categoria", 21, 0, 29, 29), ("contra_quien[].nivel_institucional", 21, 0, 29, 29),
    ("sujetos[].categoria", 22, 0, 35, 25), ("lugares[].categoria", 22, 0, 28, 20),
    ("delimitacion.es_accion_principal_con_complementarias", 3, 18, 24, 17), ("temporalidad.tipo_temporal", 21, 0, 24, 17),
    ("__aggregate__", 570, 18, 591, 423), ("temporalidad.tempo_verbal", 23, 0, 22, 15), ("alcance.categoria", 23, 0, 22, 15),
    ("incidentes.danios_materiales.presencia", 23, 0, 22, 15), ("cantidad_participantes.hay_cantidad_mencionada", 25, 0, 20, 13),
    ("lugares[].rol_en_evento", 28, 0, 22, 14), ("evento.es_evento_protesta", 28, 0, 17, 18),
    ("cantidad_participantes.es_aproximada", 26, 0, 19, 12), ("incidentes.heridos.presencia", 26, 0, 19, 12),
    ("incidentes.represion.presencia", 27, 0, 18, 11), ("incidentes.muertos.presencia", 27, 0, 18, 11),
    ("temporalidad.fecha_inicio.certeza", 28, 0, 17, 10), ("temporalidad.fecha_fin.certeza", 28, 0, 17, 10),
    ("incidentes.enfrentamiento.presencia", 28, 0, 17, 10), ("incidentes.detenidos.presencia", 28, 0, 17, 10),
    (HEADLINE_PATH, 27, 0, 5, 0),
]


def per_path(spark):
    rows = [r for r in reversed(COUNTS) if r[0] != "__aggregate__"]
    return S.path_accuracy_total(spark.createDataFrame(rows, "path string, tp long, tn long, fp long, fn long"))


def test_aggregate_row_and_rank_order(spark):
    ranked = E.rank_field_errors(per_path(spark)).orderBy("rank").collect()
    assert [r.path for r in ranked] == [c[0] for c in COUNTS]
    whole = next(r for r in ranked if r.path == "__aggregate__")
    assert (whole.tp, whole.tn, whole.fp, whole.fn, whole.support) == (570, 18, 591, 423, 1602)
    assert (whole.accuracy, ranked[0].accuracy, ranked[0].error_rate) == (0.367, 0.172, 0.828)


def test_supported_worst_and_extremes(spark):
    table = per_path(spark)
    assert [r.path for r in E.supported_worst_paths(table).orderBy("place").collect()] == [COUNTS[0][0], COUNTS[1][0]]
    few = table.where("support < 40")
    assert [r.path for r in E.supported_worst_paths(few, minimum=1000).collect()] == [HEADLINE_PATH]
    ends = E.path_extremes(table).collect()[0]
    assert (ends.best_path, ends.worst_path) == (HEADLINE_PATH, COUNTS[0][0])


def test_example_and_micro_f1(spark):
    rows = [("a", 2, 70, 4), ("b", 0, 0, 0), ("c", 3, 63, 3)]
    df = spark.createDataFrame(rows, "k string, tp long, fp long, fn long")
    got = {r.k: r.f for r in df.select("k", S.rounded(S.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f")).collect()}
    assert got == {"a": 0.0513, "b": 0.0, "c": 0.0833}


def test_run_statuses(spark):
    rows = [
        ("none valid", 5, 5, 0, 0, 2), ("blocked", 5, 6, 1, 4, 0), ("truncated", 5, 5, 0, 4, 1), ("both", 5, 6, 1, 4, 1),
        ("clean", 5, 5, 0, 5, 0), ("not all run", 4, 5, 0, 4, 0),
    ]
    df = spark.createDataFrame(rows, "run string, examples_run long, eval_total long, blocked long, schema_valid long, truncated long")
    base = {r.run: r.status for r in S.run_status_base(df).collect()}
    assert base == {"none valid": "fail", "blocked": "incomplete", "truncated": "pass_with_truncations", "both": "incomplete",
                    "clean": "pass", "not all run": "incomplete"}
    partial = {r.run: r.status for r in S.run_status_base(df, F.lit(False)).collect()}
    assert partial["not all run"] == "partial_pass" and partial["blocked"] == "partial_incomplete"
    strict = {r.run: r.status for r in S.run_status_strict(df).collect()}
    assert strict == {"none valid": "fail", "blocked": "incomplete", "truncated": "fail", "both": "fail", "clean": "pass", "not all run": "incomplete"}


def test_acceptance_and_top_status(spark):
    rows = [("a", "1.0", "0.367", "0.491"), ("b", "0.95", "0.8", "0.7"), ("c", None, "0.9", "0.9"), ("d", "x", "0.9", "0.9")]
    df = S.acceptance(spark.createDataFrame(rows, "run string, schema_validity string, categorical_accuracy_aggregate string, f1_global string"))
    got = {r.run: r.failed_criteria for r in df.collect()}
    assert got == {"a": ["categorical_accuracy_aggregate", "f1_global"], "b": [], "c": ["schema_validity"], "d": ["schema_validity"]}
    runs = [("pass", True), ("pass_with_truncations", False), ("fail", True), ("incomplete", True), ("blocked", False)]
    tops = S.top_status(spark.createDataFrame(runs, "status string, accepted boolean")).collect()
    assert [r.top_status for r in tops] == ["completed_mvp_accepted", "completed_mvp_failed", "failed", "incomplete", "blocked"]


def test_partial_runs_never_replace_the_record(spark):
    log = spark.createDataFrame(
        [("m", "1", "pass", True, 1), ("m", "2", "partial_fail", False, 2), ("n", "3", "partial_pass", False, 3)],
        "model string, run_id string, status string, is_full boolean, finished_at long",
    )
    assert [(r.model, r.run_id) for r in S.latest_full_run(log).collect()] == [("m", "1")]


def test_worst_k_and_histogram(spark):
    rows = [(f"n{i}", f, 1, fp, 1, 2, 2, 1, 1, False, True, "stop", i * 300) for i, (f, fp) in enumerate([(0.5, 1), (0.1, 3), (0.1, 9), (0.9, 0)])]
    df = spark.createDataFrame(
        rows, "nota_id string, f1 double, tp long, fp long, fn long, gold_leaves long, pred_leaves long, gold_total long, "
        "pred_total long, gold_tiene boolean, pred_tiene boolean, finish_reason string, output_tokens long")
    assert [r.nota_id for r in E.worst_k(df, "nota_id", 3).orderBy("rank").collect()] == ["n2", "n1", "n0"]
    assert [r.nota_id for r in E.worst_k(df, "nota_id", 2, by_f1_only=True).orderBy("rank").collect()] == ["n1", "n2"]
    assert E.hallucinated_worst(E.worst_k(df, "nota_id")).collect()[0].hallucinated == 4
    bins = {r.bin: r.n for r in S.token_histogram(df).collect()}
    assert bins == {"0-200": 1, "200-500": 1, "500-1000": 2, "1000-2000": 0, "2000+": 0}
