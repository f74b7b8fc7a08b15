"""Scoring of predictions against gold: per-note counts, metrics, statuses and deltas."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.compare import leaf_f1_counts, leaf_recall_counts
from marginalia.functions.paths import headline_counts, path_counts, slot_pairs
from marginalia.functions.text import budget_block
from marginalia.functions.variants import read_record, schema_valid, valid_record
from marginalia.schema import HEADLINE_PATH, SCORED_PATHS, TARGET, Node
from marginalia.session import once

# Acceptance thresholds and histogram bounds.
THRESHOLDS = (("schema_validity", 0.95), ("categorical_accuracy_aggregate", 0.80), ("f1_global", 0.70))
TOKEN_BINS = ("0-200", "200-500", "500-1000", "1000-2000", "2000+")
AGGREGATE = "__aggregate__"
F1_FIELDS = ("tp", "fp", "fn", "gold_leaves", "pred_leaves")
PARTS = ("f1", "recall", "paths")
RECALL_FIELDS = ("gold_leaves", "exact_match", "non_empty_recovery", "null_or_empty_in_gold")


def ratio(num: Column, den: Column) -> Column:
    """Quotient, zero on an empty denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def rounded(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * precision * recall, precision + recall)


# --- per note -----------------------------------------------------------------------


def parse_predictions(pred: DataFrame, raw: str = "raw_text", node: Node = TARGET) -> DataFrame:
    """Adds ``pv`` (VARIANT), ``parse_valid`` and ``schema_valid``, each computed once."""
    parsed = once(pred, pv=F.try_parse_json(raw))
    return once(parsed, schema_valid=schema_valid("pv", node)).withColumn("parse_valid", F.col("pv").isNotNull())


def align(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold and prediction of one note in one row: the only shuffle of the scoring."""
    return pred.join(gold, key, "left")


def alignment_check(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """One row: how many notes have both sides, one side, or copies."""
    sides = gold.groupBy(key).agg(F.count("*").alias("g")).join(
        pred.groupBy(key).agg(F.count("*").alias("p")), key, "full"
    )
    return sides.agg(
        F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("paired"),
        F.count_if(F.col("p").isNull()).alias("gold_only"),
        F.count_if(F.col("g").isNull()).alias("pred_only"),
        F.count_if((F.col("g") > 1) | (F.col("p") > 1)).alias("copied"),
    )


def blocked(pred: DataFrame, tokens: str = "prompt_tokens") -> DataFrame:
    """Predictions whose prompt did not fit, with the reason."""
    return pred.withColumn("reason", budget_block(F.col(tokens))).where(F.col("reason").isNotNull())


def runnable(pred: DataFrame, tokens: str = "prompt_tokens") -> DataFrame:
    return pred.where(budget_block(F.col(tokens)).isNull())


def comparable(gold: DataFrame, pred: DataFrame, key: str, gold_json: str = "gold_json", node: Node = TARGET) -> DataFrame:
    """Aligned rows with typed records ``g`` and ``p``.

    ``p`` is null unless the prediction is schema-valid, so invalid predictions cost nothing
    in the counts and only show in the validity rate. Gold must be schema-valid; notes whose
    gold is not are for ``leafjoin.leaf_counts``, which compares any JSON.
    """
    typed_gold = once(gold.select(key, gold_json), g=read_record(gold_json, node)).select(key, "g")
    parsed = once(once(pred, pv=F.try_parse_json("raw_text")), p=valid_record("pv", node))
    valid = {"parse_valid": F.col("pv").isNotNull(), "schema_valid": F.col("p").isNotNull()}
    typed_pred = parsed.withColumns(valid).drop("pv", "raw_text")
    return align(typed_gold, typed_pred, key)


def score_notes(
    aligned: DataFrame, node: Node = TARGET, paths: Sequence[tuple[str, str]] = SCORED_PATHS, parts: Sequence[str] = PARTS
) -> DataFrame:
    """Adds ``f1``, ``recall`` and ``paths`` per note, or the wanted ``parts`` of them. Narrow; zero or empty behind the score gate.

    Each part compares all leaves of a note once more, and a part that nothing reads is
    computed all the same, so callers name the parts they read.
    """
    scored = F.col("g").isNotNull() & F.col("p").isNotNull()
    none = lambda fields: F.struct(*[F.lit(0).cast("long").alias(f) for f in fields])
    per_path = F.array_compact(F.concat(F.array(headline_counts("g", "p", HEADLINE_PATH)), path_counts("g", "p", node, paths)))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<path: STRING, tp: BIGINT, tn: BIGINT, fp: BIGINT, fn: BIGINT>>)")
    counts = {
        "f1": F.when(scored, leaf_f1_counts("g", "p", node)).otherwise(none(F1_FIELDS)),
        "recall": F.when(scored, leaf_recall_counts("g", "p", node)).otherwise(none(RECALL_FIELDS)),
        "paths": F.when(scored, per_path).otherwise(empty),
    }
    counted = once(aligned, **{part: counts[part] for part in parts})
    head = lambda side: (
        F.col(f"{side}.extraccion.tiene_eventos_protesta"), F.col(f"{side}.extraccion.total_eventos_protesta"))
    (g_has, g_total), (p_has, p_total) = head("g"), head("p")
    return (
        counted.withColumn("scored", scored)
        .withColumns({"gold_tiene": g_has, "gold_total": g_total, "pred_tiene": p_has, "pred_total": p_total})
        .withColumn("pred_nota_id", F.col("p.nota.nota_id"))
        .withColumn("pred_fecha", F.col("p.nota.fecha_publicacion"))
        .drop("g", "p")
    )


def example_f1() -> Column:
    return f1_of(F.col("f1.tp"), F.col("f1.fp"), F.col("f1.fn"))


def slots(aligned: DataFrame, keep: Sequence[str], paths: Sequence[tuple[str, str]], node: Node = TARGET) -> DataFrame:
    """Long slot table of scored notes: ``keep, path_no, path, slot, gold, pred, kind, strict_kind``."""
    both = aligned.where(F.col("g").isNotNull() & F.col("p").isNotNull())
    return both.select(*keep, F.inline(slot_pairs("g", "p", node, paths)))


# --- metrics ------------------------------------------------------------------------


def micro_f1(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of summed counts."""
    sums = notes.groupBy(*by).agg(*[F.sum(f"f1.{c}").alias(c) for c in F1_FIELDS])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns(
        {
            "precision": rounded(ratio(tp, tp + fp)),
            "recall": rounded(ratio(tp, tp + fn)),
            "f1": rounded(f1_of(tp, fp, fn)),
        }
    )


def field_recall(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = notes.groupBy(*by).agg(*[F.sum(f"recall.{c}").alias(c) for c in RECALL_FIELDS])
    leaves = F.col("gold_leaves")
    return sums.withColumns(
        {
            "exact_match_recall": rounded(ratio(F.col("exact_match"), leaves)),
            "non_empty_recovery_recall": rounded(ratio(F.col("non_empty_recovery"), leaves)),
            "comparable_leaves": leaves - F.col("null_or_empty_in_gold"),
        }
    )


def with_accuracy(counts: DataFrame) -> DataFrame:
    support = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    accuracy = ratio(F.col("tp") + F.col("tn"), support)
    # the error rate is taken from the rounded accuracy
    return counts.withColumn("support", support).withColumn("accuracy", rounded(accuracy)).withColumn(
        "error_rate", F.when(support > 0, rounded(1 - rounded(accuracy))).otherwise(F.lit(0.0))
    )


def path_accuracy(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per path sums; every task sends one row per path to the shuffle."""
    long = notes.select(*by, F.inline("paths"))
    return with_accuracy(long.groupBy(*by, "path").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]))


def path_accuracy_total(per_path: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per path rows plus the aggregate row over all paths."""
    counts = ("tp", "tn", "fp", "fn")
    whole = per_path.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts]).withColumn("path", F.lit(AGGREGATE))
    return with_accuracy(per_path.select(*by, "path", *counts).unionByName(whole))


def validity(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return notes.groupBy(*by).agg(
        F.count("*").alias("examples_run"),
        F.count_if("parse_valid").alias("parse_valid"),
        F.count_if("schema_valid").alias("schema_valid"),
        F.count_if(F.col("finish_reason") == "length").alias("truncated"),
    ).withColumns(
        {
            "schema_validity": rounded(ratio(F.col("schema_valid"), F.col("examples_run"))),
            "parse_validity": rounded(ratio(F.col("parse_valid"), F.col("examples_run"))),
        }
    )


def token_timing(notes: DataFrame, total_seconds: float, by: Sequence[str] = ()) -> DataFrame:
    sums = []
    for side in ("prompt_tokens", "output_tokens"):
        sums += [
            F.min(side).alias(f"{side}_min"), F.max(side).alias(f"{side}_max"),
            rounded(F.avg(side), 1).alias(f"{side}_mean"),
        ]
    return notes.groupBy(*by).agg(
        *sums, F.sum("output_tokens").alias("output_tokens_total"),
        rounded(F.lit(total_seconds), 3).alias("total_seconds"),
        rounded(F.lit(total_seconds) / F.greatest(F.lit(1), F.count("*")), 3).alias("mean_per_example_seconds"),
    )


def elapsed_share(notes: DataFrame, total_seconds: float) -> DataFrame:
    """Wall time attributed by tokens; the total is a scalar subquery."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    whole = notes.agg(F.sum(tokens)).scalar()
    return notes.withColumn("elapsed_seconds", rounded(F.lit(total_seconds) * ratio(tokens, whole), 3))


def token_histogram(notes: DataFrame, column: str = "output_tokens") -> DataFrame:
    """``bin, n`` over the fixed bins; empty bins are kept."""
    value = F.col(column)
    name = (
        F.when(value < 200, TOKEN_BINS[0]).when(value < 500, TOKEN_BINS[1]).when(value < 1000, TOKEN_BINS[2])
        .when(value < 2000, TOKEN_BINS[3]).otherwise(TOKEN_BINS[4])
    )
    counts = notes.select(name.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = notes.sparkSession.createDataFrame([(b,) for b in TOKEN_BINS], "bin string")
    return bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def metadata_markers(parsed: DataFrame, value: str = "pv") -> DataFrame:
    """Counts of suspicious metadata over parsed predictions."""
    note_id = F.expr(f"try_variant_get({value}, '$.nota.nota_id', 'string')")
    date = F.expr(f"try_variant_get({value}, '$.nota.fecha_publicacion', 'string')")
    return parsed.where(F.col(value).isNotNull()).select(note_id.alias("i"), date.alias("d")).agg(
        F.count("*").alias("parse_valid"),
        F.count_if(F.col("i") == "S/D").alias("nota_id_sd"),
        F.count_if(F.col("i") != "S/D").alias("nota_id_other"),
        F.count_if((F.size(F.split("d", "/")) == 3) & (F.split("d", "/")[0] == "19")).alias("fecha_day_19"),
        F.count_if(F.length("d") > 0).alias("fecha_total"),
    )


def count_delta_summary(notes: DataFrame) -> DataFrame:
    delta = F.coalesce("pred_total", F.lit(0)) - F.coalesce("gold_total", F.lit(0))
    return notes.where("scored").select("gold_total", "pred_total", delta.alias("delta")).agg(
        F.sum(F.coalesce("gold_total", F.lit(0))).alias("gold_total_events"),
        F.sum(F.coalesce("pred_total", F.lit(0))).alias("pred_total_events"),
        F.sum("delta").alias("delta"),
        F.count_if(F.col("delta") == 0).alias("examples_exact_count"),
        F.count_if(F.col("delta") > 0).alias("examples_extra_count"),
        F.count_if(F.col("delta") < 0).alias("examples_missing_count"),
    )


def confusion_cell(gold: Column, pred: Column) -> Column:
    return (
        F.when(gold & pred, "tp").when(~gold & ~pred, "tn").when(pred, "fp").otherwise("fn")
    )


def confusion_counts(df: DataFrame, gold: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by, cell, n`` of two booleans; null counts as false."""
    no = F.lit(False)
    cell = confusion_cell(F.coalesce(gold, no), F.coalesce(pred, no))
    return df.withColumn("cell", cell).groupBy(*by, "cell").agg(F.count("*").alias("n"))


def confusion_examples(df: DataFrame, gold: Column, pred: Column, key: str, shown: int = 3) -> DataFrame:
    """First ids per cell; the group limit of the ranked window runs before the shuffle."""
    no = F.lit(False)
    cells = df.select(key, confusion_cell(F.coalesce(gold, no), F.coalesce(pred, no)).alias("cell"))
    order = Window.partitionBy("cell").orderBy(key)
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)


# --- run level ----------------------------------------------------------------------


def run_summary(notes: DataFrame, stopped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per run: ``examples_run, blocked, eval_total, schema_valid, truncated``."""
    ran = validity(notes, by).select(*by, "examples_run", "schema_valid", "truncated")
    held = stopped.groupBy(*by).agg(F.count("*").alias("blocked"))
    both = ran.join(held, list(by), "full").na.fill(0, ["examples_run", "schema_valid", "truncated", "blocked"])
    return both.withColumn("eval_total", F.col("examples_run") + F.col("blocked"))


def run_status_base(summary: DataFrame, full: Column | None = None) -> DataFrame:
    """Lenient policy: truncations pass with a remark; a partial run is always marked."""
    full = F.lit(True) if full is None else full
    covered = (F.col("blocked") == 0) & (~full | (F.col("examples_run") == F.col("eval_total")))
    status = (
        F.when(F.col("schema_valid") == 0, "fail").when(~covered, "incomplete")
        .when(F.col("truncated") > 0, "pass_with_truncations").otherwise("pass")
    )
    return summary.withColumn("full_coverage", covered).withColumn(
        "status", F.concat(F.when(full, F.lit("")).otherwise(F.lit("partial_")), status)
    )


def run_status_strict(summary: DataFrame) -> DataFrame:
    """Strict policy: any truncation fails, before coverage is looked at."""
    covered = (F.col("blocked") == 0) & (F.col("examples_run") == F.col("eval_total"))
    status = (
        F.when((F.col("schema_valid") == 0) | (F.col("truncated") > 0), "fail").when(~covered, "incomplete").otherwise("pass")
    )
    return summary.withColumn("full_coverage", covered).withColumn("status", status)


def acceptance(metrics: DataFrame) -> DataFrame:
    """Adds ``failed_criteria`` and ``accepted``; a missing value fails its criterion."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(name).try_cast("double") >= limit, F.lit(False)), F.lit(name)) for name, limit in THRESHOLDS])
    )
    return metrics.withColumn("failed_criteria", failed).withColumn("accepted", F.size("failed_criteria") == 0)


def top_status(runs: DataFrame) -> DataFrame:
    """One status from run status and acceptance."""
    return runs.withColumn(
        "top_status",
        F.when(F.col("status").isin("blocked", "incomplete"), F.col("status"))
        .when(F.col("status") == "fail", "failed")
        .when(F.col("accepted"), "completed_mvp_accepted").otherwise("completed_mvp_failed"),
    )


def headline_metrics(notes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long table ``by, metric, value`` of the headline metrics per run."""
    keys = list(by)
    f1 = micro_f1(notes, by).select(*keys, "precision", "recall", "f1")
    rec = field_recall(notes, by).select(*keys, "exact_match_recall", "non_empty_recovery_recall")
    val = validity(notes, by).select(*keys, "schema_validity")
    acc = path_accuracy_total(path_accuracy(notes, by), by)
    head = acc.where(F.col("path") == HEADLINE_PATH).select(*keys, F.col("accuracy").alias("tiene_accuracy"))
    agg = acc.where(F.col("path") == AGGREGATE).select(*keys, F.col("accuracy").alias("categorical_accuracy_aggregate"))
    wide = val.join(f1, keys, "left").join(head, keys, "left").join(agg, keys, "left").join(rec, keys, "left")
    wide = wide.withColumnsRenamed(
        {"f1": "f1_global", "precision": "f1_precision", "recall": "f1_recall", "exact_match_recall": "field_recall_exact",
         "non_empty_recovery_recall": "field_recall_non_empty", "tiene_accuracy": "tiene_eventos_protesta_accuracy"}
    )
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")


def delta_vs_run(metrics: DataFrame, run: str, baseline: str, other: str, key: str = "metric", value: str = "value") -> DataFrame:
    """``key, baseline, other, delta``; the delta is null when either side is missing. ``key`` is a metric or a path."""
    pick = lambda name, alias: metrics.where(F.col(run) == name).select(key, F.col(value).alias(alias))
    both = pick(baseline, "baseline").join(pick(other, "other"), key, "left")
    return both.withColumn("delta", rounded(F.col("other") - F.col("baseline")))


def run_comparison(metrics: DataFrame, run: str, runs: Sequence[str], baseline: str, best: str) -> DataFrame:
    """Metrics as rows, runs as columns, and the delta of one run against the baseline."""
    wide = metrics.groupBy("metric").pivot(run, list(runs)).agg(F.first("value"))
    return wide.withColumn("delta_vs_baseline", rounded(F.col(best) - F.col(baseline)))


def latest_full_run(run_log: DataFrame) -> DataFrame:
    """The authoritative record per model: the newest full run; partial runs never replace it."""
    newest = F.max_by(F.struct("run_id", "status"), F.struct("finished_at", "run_id"))
    return run_log.where("is_full").groupBy("model").agg(newest.alias("r")).select("model", "r.*")
