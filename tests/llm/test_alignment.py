"""Alignment of two tokenizers against a plain alignment of byte ranges, document by document."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import alignment

from .conftest import edge_rows

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FORMS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, B


def plain(rows):
    """The definition: byte ranges of all tokens, shared ends, overlaps; counts of pairs over all rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(_characters())}
    out, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = tokenizer.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_parts = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_parts = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(model.id_to_piece, b))]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            out.append((doc_id, [], [], [], ""))
            continue
        spans = lambda p: list(zip(np.cumsum([0, *map(len, p)]).tolist(), np.cumsum([*map(len, p)]).tolist()))
        sa, sb = spans(a_parts), spans(b_parts)
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in shared:
            u, v = i, j
            while i < len(sa) and sa[i][1] <= end:
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[u:i])) + "|" + ",".join(map(str, b[v:j])))
        counts.update(links)
        out.append((doc_id, a, b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[l] == most[l[1]] for l in links),
             sum(counts[l] for l in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, links, g in out]


def _characters():
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def same(df, rows):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(plain(rows), key=repr)


def more_rows():
    odd = ["<s> and </s> <|endoftext|> <unk> <0x41>", "▁ has no bytes of its own", "x▁y", "日本語のテキスト" * 40, "no" + "spaces" * 300,
           "a\x00b\r\n\tc", "  two  spaces   three ", " 　​", "😀😀 👩‍👩‍👧 é", "a" * 5000, "\n", " ", "ﬁ ½ Ⅷ ｆｕｌｌ"]
    return [(300 + k, t) for k, t in enumerate(odd)]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 20, 1])
def test_against_plain_alignment(spark, edge_docs, heavy):
    more = spark.createDataFrame(more_rows(), "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    same(alignment.align_tokenizers(docs, *FORMS, heavy), edge_rows() + more_rows())


def test_registered_query(spark):
    from marginalia.llm.queries import op11_tokenizer_alignment

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    same(op11_tokenizer_alignment(spark, folder), rows)


def test_windows_are_forgotten_and_long_ones_cut(spark, monkeypatch):
    rows = [(k, f"word{k} and more{k % 7} " + "unbroken" * k) for k in range(60)]
    monkeypatch.setattr(alignment, "WINDOWS", 3)
    monkeypatch.setattr(alignment, "BYTES", 200)
    monkeypatch.setattr(alignment, "LONG", 4)
    same(alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), *FORMS), rows)


def test_empty_table(no_docs):
    assert alignment.align_tokenizers(no_docs, *FORMS).count() == 0
