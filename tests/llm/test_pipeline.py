"""The pipeline against its stages done one by one in plain Python, where that can be said without a model."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from marginalia.llm.decontamination import contaminated_pairs  # noqa: E402
from marginalia.llm.packing import SPEC  # noqa: E402
from marginalia.llm.quality_classifier import quality_scores  # noqa: E402

from .conftest import edge_rows
from .test_duplicates import brute_near, brute_substring

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    (_, quality), (_, near), (_, cut), (_, clean), (_, pack) = corpus_pipeline.STAGES
    one = quality(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality_scores(docs, read("labels")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = near(spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == [d for d, _, _, kept in sorted(brute_near(rows, 5, 80)) if kept]
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = cut(spark, two, SF)
    want = {d: n - gone for d, n, gone, _ in brute_substring(rows, 50) if n == 0 or gone < n}
    assert {r.doc_id: len(r.text.split()) for r in three.collect()} == want and all(r.n_chars == len(r.text) for r in three.collect())
    four = clean(spark, three, SF)
    hit = {r.doc_id for r in contaminated_pairs(three, read("benchmark")).collect()}
    assert {r.doc_id for r in four.collect()} == set(want) - hit and one.columns == two.columns == three.columns == four.columns == docs.columns
    packed = pack(spark, four, SF)
    assert {r.doc_id for r in packed.collect()} == set(want) - hit
    assert corpus_pipeline.run(spark, SF).count() == packed.count() and len(SPEC) > 0


def test_edge_rows(spark, edge_docs):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edge_docs.columns
    ids = [r.doc_id for r in docs.collect()]
    assert 1 in ids and 2 in ids and ids.count(20) == 1 and 21 not in ids and ids.count(None) == 2 and len(edge_rows()) > len(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs.limit(0), SF).count() == 0


INNER = ("kept_id copies row kept kept_text n_words n_removed kept_sha256 component_id n_shingles rep node set_a set_b sig meets pivot chunk block role mark "
         "shingles key score predicted held_out quality features digest places marks wides item_id passage ids sequence_id piece start length offset a.b").split()


def test_columns_named_like_inner_ones(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {name}").alias(name) for name in INNER])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *INNER]
        assert all(r[k + 5] == f"own {name}" for r in docs.collect() for k, name in enumerate(INNER))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
