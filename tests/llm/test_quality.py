"""Quality rules and classifier: counts against brute force, held-out accuracy, monotonic trees."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm.quality_classifier import accepted, add_contexts, index_vectors, quality_scores
from marginalia.llm.quality_rules import FEATURES, STATISTICS, apply_rules, fit_trees

from .conftest import edge_rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_counts_and_base_rule(spark, edge_docs, labels):
    found = apply_rules(edge_docs, labels).collect()
    want = sorted(((d, *brute_counts(t)) for d, t in edge_rows()), key=repr)
    assert sorted(((r.doc_id, *[r[c] for c in STATISTICS]) for r in found), key=repr) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_hold_out_accuracy(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = apply_rules(docs, labels).join(labels, "doc_id").collect()
    apart = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert np.mean([r.kept == bool(r.quality) for r in apart]) >= 0.95


def test_trees_obey_the_signs():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 400)) > 0.5).astype(float)
    trees = fit_trees(x, y, [-1, 0, 1], rounds=25)
    for f, sign in ((0, -1), (2, 1)):
        grid = np.repeat(rng.random((50, 3))[:, None], 40, axis=1)
        grid[:, :, f] = np.linspace(0, 1, 40)
        steps = np.diff(trees.margin(grid.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    free = fit_trees(x, y, [0, 0, 0], rounds=25)
    assert ((free.score(x) > 0.5) == (y > 0)).mean() > 0.85 and len(FEATURES) == 11


def test_contexts_are_sums_over_neighbours():
    index = index_vectors()
    c = np.array([5, 9, 5, 5, 7], np.uint16)
    table, want = np.zeros(index.shape, np.int64), np.zeros(index.shape, np.int64)
    add_contexts(table, index, c)
    for i in range(len(c)):
        for j in (i - 1, i + 1):
            if 0 <= j < len(c):
                want[c[i]] += index[c[j]]
    assert (table == want).all()


def test_classifier_on_held_out_rows(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    apart = [r for r in rows if r.held_out and r.doc_id in known]
    assert len(apart) > 50 and np.mean([r.predicted == known[r.doc_id] for r in apart]) >= 0.95
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_edge_rows_and_no_labels(spark, edge_docs, no_docs, labels):
    found = quality_scores(edge_docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in edge_rows())
    assert all(r.held_out for r in found if r.doc_id is None)
    none = labels.limit(0)
    assert {r.score for r in quality_scores(edge_docs, none).collect()} == {0.5}
    assert quality_scores(no_docs, labels).count() == 0 and apply_rules(no_docs, none).count() == 0
    assert accepted(edge_docs, none).count() == edge_docs.count()
