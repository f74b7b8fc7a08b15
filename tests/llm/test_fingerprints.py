"""Fingerprints against a plain form of the method, window by window; order of documents; what likeness tells apart."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from marginalia.llm import fingerprints as fp

from .conftest import edge_rows, passage


def plain_level(window):
    weight = sum(round(fp.SCALE * c * math.log2(c)) for c in Counter(window).values())
    full = round(fp.SCALE * 64 * math.log2(64))
    return (full - weight) * 1000 // full


def plain_fingerprint(text, ranks):
    """The method word for word, one window after the other."""
    windows = [text[k : k + 64] for k in range(len(text) - 63)]
    rank = [int(ranks[plain_level(w)]) for w in windows]
    points = Counter()
    for k in range(max(len(windows) - 63, min(len(windows), 1))):
        run = rank[k : k + 64]
        if min(run) <= 1000:
            points[k + run.index(min(run))] += 1
    chosen = [p for p in sorted(points) if points[p] >= 16]
    if len(chosen) < 16:
        chosen = sorted(sorted(points, key=lambda p: (-points[p], p))[:16])
    features = [windows[p] for p in chosen] or ([text] if text else [])
    filters, seen = [], set()
    for h in (xxhash.xxh3_64_intdigest(f) for f in features):
        if h in seen:
            continue
        if len(seen) % 160 == 0:
            filters.append(set())
        seen.add(h)
        filters[-1] |= {h >> 11 * k & 2047 for k in range(5)}
    return filters


def plain_likeness(one, other):
    if not one or not other:
        return float(len(one) == len(other))
    if len(one) > len(other) or len(one) == len(other) and sum(map(len, one)) > sum(map(len, other)):
        one, other = other, one
    best = [max(max(0.0, (len(f & g) - len(f) * len(g) / 2048) / max(min(len(f), len(g)) - len(f) * len(g) / 2048, 1e-9)) for g in other) for f in one]
    return sum(min(1, b) * len(f) for b, f in zip(best, one)) / sum(map(len, one))


def plain_digest(filters):
    return base64.b64encode(b"".join(sum(1 << 2047 - b for b in f).to_bytes(256, "big") for f in filters)).decode()


def test_levels_of_every_window():
    rng = random.Random(2)
    data = bytes(rng.choice(b"aaab c\xc3\xa9") for _ in range(700)) + b"z" * 200 + bytes(rng.randrange(256) for _ in range(300))
    assert fp.entropy_levels(np.frombuffer(data, np.uint8)).tolist() == [plain_level(data[k : k + 64]) for k in range(len(data) - 63)]
    assert not len(fp.entropy_levels(np.frombuffer(b"x" * 63, np.uint8)))


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("splits", [1, 7])
def test_against_plain_form(spark, splits):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] < 20 or r[0] and 40 <= r[0] < 120]  # ids that stand once
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in rows] + [(300, "a" * 3000), (301, "ab" * 90), (302, "short é"), (303, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", splits)
    try:
        found = {r.doc_id: r for r in fp.fingerprint_documents(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    levels = Counter(plain_level(w) for _, t in rows for b in [(t or "").encode()] for w in (b[k : k + 64] for k in range(len(b) - 63)))
    ranks = {level: k for k, level in enumerate(sorted(range(1001), key=lambda v: (levels[v], v)))} | {v: 1001 for v in range(100)}
    assert len(found) == len(rows)
    ordered = order(rows)
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = (plain_fingerprint(x.encode(), ranks) for x in (t, new, after))
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_digest(own), plain_digest(changed))
        assert r.near_edited == pytest.approx(plain_likeness(own, changed), abs=1e-6)
        assert r.near_next == pytest.approx(plain_likeness(own, following), abs=1e-6)


def test_repeats_nulls_and_equal_texts(spark, edge_docs):
    rows = fp.fingerprint_documents(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in edge_rows())
    by_text = {}
    ids = Counter(d for d, _ in edge_rows())
    for d, t in edge_rows():
        if ids[d] == 1:
            by_text.setdefault(t or "", set()).add(next(r.fingerprint for r in rows if r.doc_id == d))
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[""] == {""}


def test_likeness_tells_copies_halves_and_others_apart():
    rng = random.Random(3)
    texts = [passage(rng, n).encode() for n in (60, 150, 400, 1500, 6000)]
    ranks = fp.ranks_of(fp.level_counts(texts))
    prints = fp.fingerprints(texts, ranks)
    halves = fp.fingerprints([t[: len(t) // 2] + passage(rng, 6000).encode()[: len(t) - len(t) // 2] for t in texts], ranks)
    for k, (own, half) in enumerate(zip(prints, halves)):
        assert fp.likeness(own, own) == 1.0 and fp.likeness(own, half) == fp.likeness(half, own)
        assert 0.25 < fp.likeness(own, half) < 0.8
        assert all(fp.likeness(own, other) < 0.2 for j, other in enumerate(prints) if j != k)
        assert np.array_equal(fp.read_digest(fp.digest(own)), own)
    assert fp.likeness(prints[0][:0], prints[0][:0]) == 1.0 and fp.likeness(prints[0], prints[0][:0]) == 0.0


def test_blocks_do_not_matter():
    rng = np.random.default_rng(1)
    one, other = rng.random((7, 2048)) < 0.3, rng.random((5, 2048)) < 0.3
    other[2] = one[4]
    assert fp.likeness(one, other, block=2) == pytest.approx(fp.likeness(one, other))


def test_one_row_and_no_row(spark, no_docs):
    docs = spark.createDataFrame([(5, "alone " * 30)], "doc_id long, text string")
    row = fp.fingerprint_documents(docs).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(("alone " * 15 + "alone " * 15).encode()).hexdigest()
    assert fp.fingerprint_documents(no_docs).count() == 0


def test_registered_query(spark):
    from marginalia.llm.queries import op12_document_fingerprints

    folder = "/root/testdata/sf0.001"
    rows = order([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    found = {r.doc_id: r for r in op12_document_fingerprints(spark, folder).collect()}
    ranks = fp.ranks_of(fp.level_counts([t.encode() for _, t in rows]))
    copies = 0
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        new = fp.edited(t, after)
        own, changed, following = fp.fingerprints([x.encode() for x in (t, new, after)], ranks)
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (
            fp.digest(own), fp.digest(changed), fp.likeness(own, changed), fp.likeness(own, following))
        copies += r.near_edited > r.near_next
    assert len(found) == len(rows) and copies > 0.9 * len(rows)
