"""Benchmark items against a search by brute force, and planted paraphrases."""

import random

import numpy as np

from marginalia.llm.decontamination import build_spaces, clean_documents, contaminated_pairs, lcs_length, lcs_of_parts, plain_words, _parts, _places

from .conftest import passage

SF = "/root/testdata/sf0.01"


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(30))], [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lcs_length(a, _places(b), len(b)) == t[-1, -1]


def test_every_verbatim_item_is_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, bench).collect()}
    want, items = set(), [(r.item_id, plain_words(r.text)) for r in bench.collect()]
    for r in docs.collect():
        text = b" " + b" ".join(plain_words(r.text)) + b" "
        want |= {(r.doc_id, i) for i, w in items if b" " + b" ".join(w) + b" " in text}
    assert want and want <= found and len(found - want) <= 0.02 * len(want) + 1


def planted(spark):
    rng = random.Random(3)
    items = [(k, passage(rng, rng.randrange(18, 60))) for k in range(40)] + [(50, None), (51, ""), (None, "a b c d"), (52, items_text := passage(rng, 30)), (53, items_text)]
    docs, leaks = [], set()
    for k in range(300):
        text = passage(rng, rng.randrange(30, 400)).split()
        if k % 5 == 0:
            item, own = items[k // 5 % 40]
            own = own.split()
            for j in rng.sample(range(len(own) * 3 // 4), len(own) // 5 if k % 2 else 0):  # paraphrased, its end kept
                own[j] = f"z{rng.randrange(10**6)}"
            at = rng.randrange(len(text))
            text[at:at] = own
            leaks.add((k, item))
        docs.append((k, " ".join(text).upper() if k % 3 else " ".join(text), 1.0))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (None, items[0][1], 0.0), (1002, items[1][1], 0.0), (1002, items[1][1], 0.0), (1003, items_text, 0.0),
             (1004, passage(rng, 20000) + " " + items[2][1] + " " + passage(rng, 20000), 0.0)]
    leaks |= {(None, 0), (1002, 1), (1003, 52), (1003, 53), (1004, 2)}
    return spark.createDataFrame(docs, "doc_id long, text string, cosine double"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_paraphrases_and_edge_cases(spark):
    docs, bench, leaks = planted(spark)
    found = contaminated_pairs(docs.repartition(3), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs & leaks) >= 0.97 * len(leaks) and not pairs - leaks
    assert {(1003, 52), (1003, 53), (None, 0), (1004, 2)} <= pairs and sum(r.doc_id == 1002 for r in found) == 2
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in pairs}


def test_items_in_turns_and_a_hot_item(spark):
    docs, bench, leaks = planted(spark)
    many = docs.unionByName(spark.range(2000, 2400).join(bench.where("item_id = 3")).selectExpr("id AS doc_id", "concat('own', id, ' ', text) AS text", "0D AS cosine"))
    pairs = {(r.doc_id, r.item_id) for r in contaminated_pairs(many, bench, block_items=16).collect()}
    assert {(d, 3) for d in range(2000, 2400)} <= pairs and len(pairs & leaks) >= 0.97 * len(leaks)
    assert len(build_spaces(docs, bench, block_items=16)) == 3


def test_empty_tables(spark):
    docs, bench, _ = planted(spark)
    assert contaminated_pairs(docs.limit(0), bench).count() == 0 and contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_lcs_in_parts():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(40))], [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        assert lcs_of_parts(a, _parts(b, rng.randrange(1, 9))) == lcs_length(a, _places(b), len(b))


def test_items_of_any_length(spark):
    rng = random.Random(7)
    lengths = (20, 59, 64, 65, 96, 128, 129, 300, 1500, 6000)
    items = [(k, passage(rng, n)) for k, n in enumerate(lengths)]
    docs, leaks = [], set()
    for k, own in items:
        for copy in range(4):
            words = own.split()
            for j in rng.sample(range(len(words) * 3 // 4), len(words) // 5 if copy % 2 else 0):  # paraphrased, its end kept
                words[j] = f"z{rng.randrange(10**6)}"
            around = rng.randrange(400)
            docs.append((10 * k + copy, " ".join([passage(rng, around), *words, passage(rng, 100)])))
            leaks.add((10 * k + copy, k))
        docs.append((10 * k + 5, " ".join(own.split()[: len(own.split()) // 3])))  # a third of an item is no leak
    docs += [(1000 + k, passage(rng, rng.randrange(30, 600))) for k in range(300)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = contaminated_pairs(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks and {r.item_words for r in found} == set(lengths)
    assert {r.doc_id for r in clean_documents(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in leaks}
    assert [(s.block, len(s.items)) for s in build_spaces(docs, bench)] == [(32, 3), (64, 3), (128, 1), (256, 1), (1024, 1), (4096, 1)]
