"""Incremental ingest: new response files are classified as they arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from marginalia.operators import ingest
from marginalia.schema import Node
from marginalia.sources.readers import parse_lines

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE = ["file", "block", "line"]
ROW = "custom_id string, row_index long, record string, " + ", ".join(f"{u} long" for u in ingest.USAGE)
ERROR = "file string, block long, line long, error_type string, error string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of a line in its file split; a task reads its splits one after the other."""
    at, number = None, 0
    for batch in batches:
        numbers = []
        for place in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            at, number = (place, number + 1) if place == at else (place, 1)
            numbers.append(number)
        yield batch.append_column("line", pa.array(numbers, pa.int64()))


def _first_answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Errors as they are; of the answers to one id the first, unless an earlier batch had one."""
    answered, first = state.exists, None
    for frame in frames:
        errors = frame[frame["error_type"].notna()]
        if len(errors):
            yield errors
        if not answered and len(errors) < len(frame):
            rows = [frame[frame["error_type"].isna()]] + ([first] if first is not None else [])
            first = pd.concat(rows).sort_values(PLACE).head(1)
    if first is not None:
        state.update((True,))
        yield first


def incremental_ingest(
    spark: SparkSession, responses: str, manifest: DataFrame, out: str, errors: str, checkpoint: str,
    schema: Node | None = None, **settings: str,
) -> StreamingQuery:
    """Runs the batch ingest over every new file below ``responses`` and stops when done.

    The first answer to an id stays: within a batch by file path and place in the file, between
    batches by the state store, which holds one flag per answered id. Earlier output is not read
    again. ``ingest.successes(..., first=True)`` is the same rule over one table. Lines that fail
    keep no state, and each is a group of its own. Each micro batch writes its own ``batch=<id>``
    folder in overwrite mode, so a batch that is retried replaces its own output.
    """
    lines = spark.readStream.text(responses).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbered = lines.mapInArrow(_numbered, "value string, file string, block long, line long")
    read = parse_lines(numbered.where(F.length(F.trim("value")) > 0).select(
        F.struct(*PLACE).alias("line_no"), F.col("value").alias("line")))
    classified = ingest.classify(read, manifest, schema, **settings).select(
        "line_no.*", "error_type", "error", "custom_id", "row_index", F.to_json("record").alias("record"), "usage.*")
    lone = F.when(F.col("error_type").isNotNull(), F.concat_ws(":", *PLACE))  # a hot unknown id then is no group
    spec = f"{ERROR}, {ROW}"
    names = [c.split()[0] for c in spec.split(", ")]
    rows = classified.select(*names, lone.alias("lone")).groupBy("custom_id", "lone").applyInPandasWithState(
        lambda key, frames, state: (f[names] for f in _first_answer(key, frames, state)), spec, "answered boolean", "append", "NoTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # both tables below read it; a lost executor's part is computed again
        good = batch.where(F.col("error_type").isNull())
        good.select(*[c.split()[0] for c in ROW.split(", ")]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.where(F.col("error_type").isNotNull()).select("custom_id", *[c.split()[0] for c in ERROR.split(", ")]).write.mode("overwrite").parquet(f"{errors}/batch={batch_id}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """Manifest rows that still need an output: the next run's work list."""
    try:
        done = spark.read.schema("custom_id string").option("basePath", out).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return manifest
    return manifest.join(done.select("custom_id"), "custom_id", "left_anti")
