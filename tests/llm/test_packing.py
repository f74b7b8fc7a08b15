"""Packing: exact round trip, ids equal to the other tokenizer library, fill."""

import math
import zlib

import numpy as np
import pytest

from marginalia.llm.packing import OpenBins, best_fit_packing

from .conftest import edge_rows

P = pytest.importorskip("public_tokenizers")


def test_round_trip_and_fill(spark, edge_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    docs = edge_docs.select("doc_id", "text").union(given).coalesce(2)
    rows = edge_rows() + [tuple(r) for r in given.collect()]
    found = best_fit_packing(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    want = sorted(((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in rows), key=repr)
    have, sequences = {}, {}
    for r in found:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lone = [r for r in found if r.doc_id not in (None, 20, 21, 200)]
    for r in sorted(lone, key=lambda r: r.piece):
        have.setdefault(r.doc_id, []).extend(r.ids)
    assert sorted(((d, tuple(i)) for d, i in have.items()), key=repr) == [w for w in want if w[0] not in (None, 20, 21, 200)]
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) <= 1024
    assert len(sequences) <= math.ceil(sum(len(i) for _, i in want) / 1024) * 1.02 + 3


def test_fullest_bin_closes_first():
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (8, 7, 6)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.place(2) == (1, 7)  # bin 0 had the least space and closed


def test_empty_table(no_docs):
    assert best_fit_packing(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_added_tokens_as_in_the_tokenizers_file(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from marginalia.llm.queries import op7_packing

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x<|endoftext|", "<|ENDOFTEXT|> \n<|endoftext|>\n", "w1 w2<|endoftext|> " * 700, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: [*tokenizer.encode(t or "").ids, 2] for d, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 2]
    have = {}
    for r in sorted(corpus_pipeline.packing(spark, docs, str(tmp_path)).collect(), key=lambda r: r.piece):
        have.setdefault(r.doc_id, []).extend(r.ids)
    assert have == want
    for r in op7_packing(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
