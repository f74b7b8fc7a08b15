"""Near and substring duplicates against brute force."""

import hashlib
import random
import re

import pytest

from marginalia.llm.near_dedup import near_duplicates, pivot_meetings, rest_meetings
from marginalia.llm.substring_dedup import repeated_passages

from .conftest import edge_rows, passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_near(rows, n, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    ids = sorted({(s, d) for s, (d, _) in zip(sets, rows) if d is not None and s}, key=lambda x: x[1])
    nodes = list({s for s, _ in ids})
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i):
            common = len(a & nodes[j])
            if 100 * common >= percent * (len(a) + len(nodes[j]) - common):
                root[find(i)] = find(j)
    place = {s: i for i, s in enumerate(nodes)}
    low = {}
    for s, d in ids:
        r = find(place[s])
        low[r] = min(low.get(r, d), d)
    out = []
    for s, (d, _) in zip(sets, rows):
        c = None if d is None else low[find(place[s])] if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def brute_substring(rows, window):
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for w, (d, _) in zip(split, rows):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for w, (d, _) in zip(split, rows):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("n,percent,block", [(3, 85, 10**6), (5, 80, 10**6), (3, 85, 2000)])
def test_near_duplicates_equal_brute_force(spark, edge_docs, n, percent, block):
    rows = edge_rows() + [(d + 1000, t) for d, t in given(spark)]
    docs = edge_docs.select("doc_id", "text", "component_id", "rep").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "1L AS component_id", "2L AS rep"))
    found = near_duplicates(docs, n, percent, 32 if percent == 85 else 40, block_shingles=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_near(rows, n, percent)


def test_an_id_with_many_texts_links_by_each(spark):
    rng = random.Random(4)
    a, b, c = (passage(rng, 80) for _ in range(3))
    rows = [(7, a), (7, b), (7, c), (3, a + " x"), (5, b + " y"), (9, c + " z"), (9, "another text of its own"), (8, b + " y y2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (10**6, 100):
        assert sorted((tuple(r) for r in near_duplicates(docs, 3, 85, 32, block_shingles=block).collect()), key=repr) == brute_near(rows, 3, 85)


def test_rows_sent_grow_with_the_members(spark):
    """A family of near copies: one row per member and chunk for the pivot, and nothing more where the pivot links all."""
    n, size = 4000, 300
    for block in (60_000, 6_000, 1_500):
        nb = -(-n * size // block)
        groups = spark.range(n).selectExpr("0L AS pivot", "id AS node", "id AS rep", "id AS set_a", f"{size}L AS size", f"{nb}L AS nb")
        assert pivot_meetings(groups).count() == n + nb
        linked = spark.range(1, n).selectExpr("0L AS a", "id AS b")
        assert rest_meetings(groups, linked, block).count() == 0
        assert rest_meetings(groups, linked.where("b > 3"), block).count() == n + 3 * nb


def test_one_id_with_two_texts_keeps_both_results(spark, edge_docs):
    found = near_duplicates(edge_docs, 3, 85, 32).where("doc_id = 200").collect()
    own = sorted(n for _, n, _, _ in brute_near([r for r in edge_rows() if r[0] == 200], 3, 85))
    assert sorted(r.n_shingles for r in found) == own and all(r.kept for r in found)


@pytest.mark.parametrize("window", [50, 7])
def test_repeated_passages_equal_brute_force(spark, edge_docs, window):
    rows = edge_rows() + [(d + 1000, t) for d, t in given(spark)]
    docs = edge_docs.select("doc_id", "text", "digest", "places").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "1L AS digest", "'' AS places"))
    found = repeated_passages(docs, window)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_substring(rows, window)


def test_kept_text_keeps_lines(spark):
    a = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"head\n{a}\ntail"), (2, f"own  line\n{a}\nmore"), (3, "as  it is")], "doc_id long, text string")
    found = {r.doc_id: r.kept_text for r in repeated_passages(docs, 50, with_rows=True).collect()}
    assert found == {1: f"head\n{a}\ntail", 2: "own  line\nmore", 3: "as  it is"}


def test_empty_tables(no_docs):
    assert near_duplicates(no_docs).count() == 0 and repeated_passages(no_docs).count() == 0
