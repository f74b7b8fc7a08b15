"""Leaf comparison of arbitrary JSON: both walks of a note joined on the path.

The general counterpart of ``marginalia.functions.compare`` for records that need not
follow a schema. Keys may be missing, nulls may stand in lists and containers of different
kinds may meet at one path. The records of a note meet as text and are walked side by side
in Arrow batches: their paths, many times as long as the records, are never shuffled or stored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import product
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from marginalia.functions.text import json_quoted
from marginalia.operators.walk import ARROW_TYPES, BATCH_NODES, Number, visit

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_COLUMNS = (
    "path", "gold_type", "gold_value", "gold_parent", "pred_type", "pred_value", "pred_parent", "parent", "is_slot",
    "gold_at_parent", "pred_at_parent", "parent_is_slot",
)
FLAGS = ("is_slot", "parent_is_slot")
#: Of these characters those below a path sort right after it.
ORDER = str.maketrans(".[", "\u0001\u0002")
ABSENT = (None, None, None)


def _by_path(texts: list[str], side: int, found: dict[str, tuple[list, list]]) -> None:
    for text in texts:
        out: list[list] = [[] for _ in ARROW_TYPES]
        visit(json.loads(text, parse_float=Number), ("path", "parent_path"), None, out)
        for path, above, kind, value in zip(out[0], out[4], out[6], out[7]):
            if path not in found:
                found[path] = ([], [])
            found[path][side].append((kind, value, above))


def _pairs(found: dict[str, tuple[list, list]]) -> Iterator[tuple[Any, ...]]:
    """The pairs of a note. A list against a record at one path: nothing below the record takes part."""
    pairs = {
        path: list(product(gold, pred)) if gold and pred else [(g, ABSENT) for g in gold] + [(ABSENT, p) for p in pred]
        for path, (gold, pred) in found.items()
    }
    at, gold_record = None, False
    for path in sorted(pairs, key=lambda path: path.translate(ORDER)):
        below = at is not None and (path.startswith(f"{at}.") if at else not path.startswith("["))
        for (g_type, g_value, g_parent), (p_type, p_value, p_parent) in pairs[path]:
            if below and gold_record == (g_type is not None) and (g_type is None or p_type is None):
                continue
            parent = p_parent if g_parent is None else g_parent
            own = (path, g_type, g_value, g_parent, p_type, p_value, p_parent, parent, path.endswith("]"))
            if parent is None:
                yield *own, None, None, None
            else:
                for g, p in pairs.get(parent, [(ABSENT, ABSENT)]):
                    yield *own, g[0], p[0], parent.endswith("]")
        # all paths below a path follow it at once, so the last clash passed is the only one that can enclose a path
        for g, p in pairs[path]:
            if (g[0], p[0]) in (("array", "object"), ("object", "array")):
                at, gold_record = path, g[0] == "object"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        out: list[tuple[Any, ...]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(PAIR_COLUMNS)
            types = [pa.bool_() if c in FLAGS else pa.string() for c in PAIR_COLUMNS]
            sides = [pa.array(column, t) for column, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *sides], names=[batch.schema.names[0], *PAIR_COLUMNS])

        keyless = batch.column(0).is_null().to_pylist()
        for number, (lone, golds, preds) in enumerate(zip(keyless, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            # records without a key meet no other
            for texts in ((golds, []), ([], preds)) if lone else ((golds, preds),):
                found: dict[str, tuple[list, list]] = {}
                for side in (0, 1):
                    _by_path(texts[side], side, found)
                out += ((*pair[:9], None, None, None) for pair in _pairs(found)) if lone else _pairs(found)
            rows += [number] * (len(out) - len(rows))
            if len(rows) >= BATCH_NODES:
                yield flush()
                rows, out = [], []
        yield flush()


def leaf_pairs(gold: DataFrame, gold_value: str, pred: DataFrame, pred_value: str, key: str) -> DataFrame:
    """Every path of either side once: types, values and the partner's kind at the parent.

    The records of a key are gathered as text, which is the only shuffle; there is none where
    one frame holds both sides and is already laid out by key. Of a key that stands on more
    than one row all records of one side meet all of the other.
    """
    text = lambda value: F.to_json(F.col(value))
    if gold is pred:
        sides = gold.select(key, text(gold_value).alias("__gold"), text(pred_value).alias("__pred"))
    else:
        none = F.lit(None).cast("string")
        sides = gold.select(key, text(gold_value).alias("__gold"), none.alias("__pred")).unionByName(
            pred.select(key, none.alias("__gold"), text(pred_value).alias("__pred")))
    # rows without a key are no group
    apart = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    notes = sides.withColumn("__apart", apart).groupBy(key, "__apart").agg(
        F.collect_list("__gold").alias("__gold"), F.collect_list("__pred").alias("__pred")).drop("__apart")
    spec = T.StructType([notes.schema[key]] + [T.StructField(c, T.BooleanType() if c in FLAGS else T.StringType()) for c in PAIR_COLUMNS])

    def as_json(side: str):
        kind, value = F.col(f"{side}_type"), F.col(f"{side}_value")
        return F.when(kind == "string", json_quoted(value)).when(kind == "null", "null").otherwise(value)

    pairs = notes.mapInArrow(_paired, spec)
    return pairs.withColumns({f"{side}_value": as_json(side) for side in ("gold", "pred")})


def _leaf(side: str):
    return F.col(f"{side}_type").isNotNull() & ~F.col(f"{side}_type").isin("object", "array")


def leaf_counts(pairs: DataFrame, key: str) -> DataFrame:
    """``key`` and the counts of leaf F1 and leaf recall."""
    g, p = _leaf("gold"), _leaf("pred")
    g_null, p_null = F.col("gold_type") == "null", F.col("pred_type") == "null"
    g_none, p_none = F.col("gold_type").isNull(), F.col("pred_type").isNull()
    slot = F.col("is_slot")
    equal = F.col("gold_value") == F.col("pred_value")
    # a null slot without partner matches the absent slot when the lists themselves are compared
    reached_pred = F.col("pred_at_parent").isNotNull() & ~(F.col("parent_is_slot") & (F.col("pred_at_parent") == "null"))
    reached_gold = F.col("gold_at_parent").isNotNull() & ~(F.col("parent_is_slot") & (F.col("gold_at_parent") == "null"))
    lone_null = slot & ((g & g_null & p_none & reached_pred) | (p & p_null & g_none & reached_gold))
    both = g & p
    slot_null = slot & both & (g_null != p_null)
    tp = (both & equal) | lone_null
    wrong = both & ~equal & ~slot_null
    fn = wrong | (slot_null & p_null) | (g & p_none & ~lone_null)
    fp = wrong | (slot_null & g_null) | (p & g_none & ~lone_null)

    g_empty = g_null | (F.col("gold_value") == '""')
    p_filled = p & ~p_null & (F.col("pred_value") != '""')
    # a predicted primitive in a slot gold lacks is an empty gold leaf where the list is reached
    phantom = slot & p & g_none & F.col("gold_at_parent").isNotNull()
    recalled = (g & (p | p_none)) | phantom
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pairs.groupBy(key).agg(
        n(tp).alias("tp"), n(fp).alias("fp"), n(fn).alias("fn"),
        n(recalled).alias("gold_leaves"), n(both & equal & ~g_empty).alias("exact_match"),
        n(both & ~g_empty & p_filled).alias("non_empty_recovery"),
        n((g & (p | p_none) & g_empty) | phantom).alias("null_or_empty_in_gold"),
    )
