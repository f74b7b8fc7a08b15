"""Ranked search against scores of all documents, one by one."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from marginalia.llm import lexical_search as ls

from .conftest import edge_rows, passage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(rows, items, top=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_all, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n_all // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k + 1, s[2], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items():
    rng = random.Random(8)
    rows = [t for _, t in edge_rows() if t and len(t) > 200]
    cut = [" ".join(t.split()[3:30]) for t in rows[:6]]
    texts = [*cut, None, "", " ,.- ", "nothing of this kind", "one", "ONE One, one", "the of and the", "é naïve ü", "it's x_y 45 <|endoftext|>", passage(rng, 400)]
    return [(k, t) for k, t in enumerate(texts)] + [(3, "two words"), (None, "two words one")]


def test_terms():
    rng = random.Random(4)
    alphabet = "aZ09 _'-\n\t\x00\x7f\x80\x85\xa0éßİı中😀@[`{/:"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert [t.decode() for t in ls.terms(text)] == plain_terms(text)
    assert ls.terms(None) == []


@pytest.mark.parametrize("limits", [(256, 20000), (3, 20000), (256, 12)])
def test_against_all_scores(spark, edge_docs, limits):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items()], "item_id long, text string, doc_id string, score int")
    assert found(ls.ranked_search(edge_docs, asked, 10, *limits)) == plain(edge_rows(), items())


def test_ties_go_by_id_across_partitions(spark):
    rows = [(k, "same words here") for k in range(500, 0, -1)] + [(0, "same words")] + [(None, "same words here")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    asked = [(1, "words words same"), (2, "here")]
    have = found(ls.ranked_search(docs, spark.createDataFrame(asked, "item_id long, text string"), top=4))
    assert have == plain(rows, asked, 4) and [r[2] for r in have if r[0] == 2] == [1, 2, 3, 4]


def test_bounds_hold_and_save_work():
    rng = random.Random(6)
    texts = [passage(rng, rng.choice((5, 60, 300, 2000))) for _ in range(400)]
    queries = [" ".join(t.split()[:30]) for t in texts[::40]]
    block = next(ls.blocks(enumerate(queries)))
    counts = [Counter(ls.terms(t)) for t in texts]
    codes = ls.Codes(block.terms)
    asked = [np.array([codes.query_terms[t] for t in c]) for c in block.counts]
    weights = np.array([ls.weight(len(texts), sum(t in c for c in counts)) for t in block.terms])
    pairs = [(k, weights[k] * np.array(list(c.values()))) for k, c in zip(asked, block.counts)]
    n = np.array([sum(c.values()) for c in counts])
    sketches = ls.Sketches(counts, 25 + 75 * n * len(texts) // int(n.sum()), codes)
    matrix = ls.weight_matrix(len(block.terms), pairs)
    exact = sketches.exact() @ matrix
    assert (sketches.bounds(matrix) >= exact).all()
    best = [ls.Best(10) for _ in queries]
    rescored = ls.search_group(sketches, list(range(len(texts))), pairs, matrix, best)
    assert rescored < 0.4 * len(texts) * len(queries)
    for k, held in enumerate(best):
        assert [s for s, _ in held.rows] == sorted(exact[:, k][exact[:, k] > 0].astype(int).tolist(), reverse=True)[:10]


def test_empty_tables(spark, no_docs, edge_docs):
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert found(ls.ranked_search(no_docs, asked)) == [] and found(ls.ranked_search(edge_docs, asked.limit(0))) == []


@pytest.mark.parametrize("name", ["op1_near_dedup", "op4_substring_dedup", "op13_ranked_search"])
def test_registered_query_equals_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))
    from check_queries import check, connect

    from marginalia.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    same, message, _, _ = check(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name])
    assert same, message
