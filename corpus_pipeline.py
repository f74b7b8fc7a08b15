"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor kept, written as Parquet in between, and all but the
last return the columns of ``documents``. ``run`` writes the stages in between to the folder
that all executors share.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginalia.llm.common import table  # noqa: E402
from marginalia.llm.decontamination import clean_documents  # noqa: E402
from marginalia.llm.near_dedup import near_duplicates  # noqa: E402
from marginalia.llm.packing import added_tokens, best_fit_packing  # noqa: E402
from marginalia.llm.quality_classifier import accepted  # noqa: E402
from marginalia.llm.substring_dedup import repeated_passages  # noqa: E402
from marginalia.session import ensure_checkpoint_dir  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject, with all their columns. Without labels all stay."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group (five words, similarity 0.8) stays; a group of copies keeps one row.

    Rows without doc_id stay, and empty texts, which are near nothing. Of rows that share a
    doc_id and a text one stays. Other columns may have any name.
    """
    kept_id = f"kept_{uuid.uuid4().hex}"  # no column of the documents has it
    kept = near_duplicates(docs, words=5, percent=80).where("kept AND doc_id IS NOT NULL")
    kept = kept.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias("copies"))
    same = F.col("doc_id") == F.col(kept_id)
    rows = docs.join(kept.select(kept_id), same, "left_semi")
    again = kept.where("copies > 1").select(kept_id)
    if not again.isEmpty():
        once = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document of a smaller doc_id has; emptied documents go, those without words stay."""
    found = repeated_passages(docs, window=50, with_rows=True).where("n_removed = 0 OR n_removed < n_words")
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, with all their columns; null and empty texts stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 ids, with their ids; null and empty texts give one piece."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, added=added)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("substring removal", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Learnt models and tokenizers cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
