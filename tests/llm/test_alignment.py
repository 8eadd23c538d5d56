"""Token groups, links and counts against plain loops over the tokenizers' own output."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from landshift.llm import alignment
from landshift.llm.bpe import byte_symbols
from landshift.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def brute(texts):
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    value = {s: i for i, s in enumerate(byte_symbols())}
    pieces = {i: bytes(value[c] for c in t) for t, i in a_side.get_vocab(with_added_tokens=False).items()}
    found = []
    for text in texts:
        a, b = [], []
        if text:
            for i in a_side.encode(" " + text, add_special_tokens=False).ids:
                start = a[-1][2] if a else 0
                a.append((i, start, start + len(pieces[i])))
            joined = b""
            for i in b_side.encode(text):
                piece = b_side.id_to_piece(i)
                data = bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()
                b.append((i, len(joined), len(joined) + len(data)))
                joined += data
            if joined != (" " + text).encode() or b"".join(pieces[t[0]] for t in a) != joined:
                a, b = [], []
        cuts = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t in side if last < t[2] <= cut) for side in (a, b)))
            last = cut
        pairs = []
        j = 0
        for x in a:
            while j < len(b) and b[j][2] <= x[1]:
                j += 1
            k = j
            while k < len(b) and b[k][1] < x[2]:
                pairs.append((x[0], b[k][0]))
                k += 1
        found.append((a, b, groups, pairs))
    count = Counter(p for f in found for p in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), ";".join(groups))
            for a, b, groups, pairs in found]


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: r for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        digest = hashlib.sha256(w[6].encode()).hexdigest() if w[0] else ""
        assert tuple(got[r.doc_id][1:]) == (*w[:6], digest), r.doc_id


ODD = [None, "", " ", "   ", "a", "a  b", " a", "a ", "a\n b", "a\n\n  b\tc", "one\ntwo\n\nthree \nfour\n", "\na", "1\n2 3\n.", "a  b", "x\x1c y", "don't  'S 12345678 ... !!!", "é é 日本語 text", "😀 😀😀", "a▁b c",
       "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "a\x00b", "0" * 3000, "ab" * 4000, "word " * 2000, "same same", "same same"]


@pytest.mark.parametrize("head_pairs", [1_000_000, 20, 0])
def test_odd_texts(spark, head_pairs, monkeypatch):
    """With all counts broadcast, with some, and with none; and with a cache that never lasts."""
    if head_pairs == 20:
        monkeypatch.setattr(alignment, "CACHED_UNITS", 3)
    df = spark.createDataFrame([(i % 40 if i % 7 else None, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, pair string")
    out = alignment.align_tokenizers(df, A, B, head_pairs=head_pairs)
    assert out.columns == ["doc_id", *NAMES]
    want = sorted(((i % 40 if i % 7 else None, *w) for i, w in enumerate(brute(ODD))), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(df, A, B).collect() == []


def test_units_join_to_the_text():
    for text in filter(None, ODD):
        assert "".join(alignment.units(text)) == " " + text
