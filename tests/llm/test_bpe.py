"""BPE against the tokenizers library, and the transducer against a dictionary."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from landshift.llm import bpe
from landshift.llm.queries import QUERIES
from landshift.llm.transducer import Transducer, compile_words

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "Hello World's don't I'LL we're", "ΑΣ Σ<|endoftext|>ΑΣ ς", "İstanbul ẞ ǅ ﬁ ½x² Ⅷ १२ à́ é",
    "a!\x85!b\xa0!​!﻿!\x1c!　!᠎", "<|startoftext|><|endoftext|><|startoftext|", "日本語のテキスト 👍🏽 ʼs 'sx ''s", "x" * 3000,
    "ab" * 4000 + "'" * 90, "the the the", "\x00\x01", "_under_score__ 12,345.67%", "q" * 39 + " " + "thing" * 9,
]


def expected(texts):
    tok = Tokenizer.from_file(PATH)
    out = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((ids, tok.decode(ids, skip_special_tokens=False)))
    return out


def test_transducer():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randrange(0, 9))) for _ in range(600)})
    outs = [bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in words]
    auto = Transducer(compile_words(words, outs))
    assert [auto.get(w) for w in words] == outs
    known = set(words)
    assert all(auto.get(w + x) is None for w in words for x in (b"a", b"\xc3", b"zz") if w + x not in known)
    assert auto.states < sum(map(len, words)) / 3  # suffixes are shared
    assert Transducer(compile_words([], [])).get(b"a") is None


@pytest.mark.parametrize("size", [0, 5, 60_000])
def test_like_the_library(spark, size):
    vocabulary = bpe.Vocabulary(PATH)
    df = spark.createDataFrame([(i, t, "x", b"") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string, ids binary")
    encoded = bpe.encode_documents(df, vocabulary, bpe.build_lexicon(df, vocabulary, size))
    got = {r.doc_id: r for r in bpe.decode_documents(encoded, vocabulary).collect()}
    for i, (ids, text) in enumerate(expected(TEXTS)):
        assert list(memoryview(bytes(got[i].ids)).cast("I")) == ids, TEXTS[i]
        assert got[i].decoded == text


def test_both_merges():
    vocabulary, rng = bpe.Vocabulary(PATH), random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("aaabetinghéß") for _ in range(rng.randrange(1, 60))).encode()
        assert vocabulary.merge(word) == vocabulary.merge_long(word)


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op4_bpe_encode_decode"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (ids, text) in zip(rows, expected([r.text for r in rows])):
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encode_decode(df, PATH).collect()) == [0, 2, 2]
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []
