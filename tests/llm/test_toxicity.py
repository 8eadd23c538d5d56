"""Viterbi decoding against all readings, restored obfuscations, and held-out separation."""

import itertools
import zlib

import numpy as np
import pytest

from landshift.llm import toxicity as tx
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def characters(spark):
    words = "you are an idiot and a stupid person the moron said so a book is good see you all too soon"
    df = spark.createDataFrame([(words,)] * 40, "text string")
    return tx.character_model(df)


def test_counts_follow_the_texts(spark, characters):
    one = tx.character_model(spark.createDataFrame([("ab",), (None,), ("",)], "text string"))
    a, b = tx.CLASS["a"], tx.CLASS["b"]
    assert one[0, a, b] > one[0, a, a] and one.shape == (64, 64, 64)
    assert np.allclose(np.exp(characters).sum(axis=2), 1, atol=1e-3)


@pytest.mark.parametrize("token", ["1d10t", "id1ot", "st*p1d", "aab", "i d i o t", "m0r0n"])
def test_viterbi_is_best(characters, token, monkeypatch):
    monkeypatch.setattr(tx, "BEAM", 10**6)

    def score(text):
        a, b, total = 0, 0, 0.0
        for c in text + " ":
            k = tx.CLASS.get(c, 0 if c == " " else tx.OTHER)
            total, a, b = total + float(characters[a, b, k]), b, k
        return total

    best = max((sum(w[1] for w in ways) + score(t := "".join(w[0] for w in ways)), t) for ways in itertools.product(*tx.lattice(token)))
    assert tx.decode(token, characters) == best[1]


def test_restored(characters):
    restored = {"1d10t": "idiot", "idiooooot": "idiot", "m0r0n": "moron", "i-d-i-o-t": "idiot", "$tup1d": "stupid", "i d i o t": "idiot"}
    for token, word in restored.items():
        assert word in tx.readings(token, characters), token
    assert tx.readings("good,", characters) == ["good"]
    assert tx.spaced("x i d i o t so a b".split()) == ["x i d i o t"]


def test_held_out_separation(spark):
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for d, r in got.items())
    tested = [(got[d].score, got[d].predicted, t) for d, t in labels.items() if d in got and got[d].held_out]
    toxic, clean = [x for x in tested if x[2]], [x for x in tested if not x[2]]
    assert sum(x[1] for x in toxic) / len(toxic) > 0.85
    assert sum(x[1] for x in clean) / len(clean) < 0.04


def test_edges(spark):
    docs = [(i, "you idiot go away" if i % 2 else "have a nice day", "t") for i in range(80)]
    docs += [(None, None, "t"), (100, "", "t"), (101, "you 1d10t", "t"), (101, "idiot " * 9000, "t"), (102, "a nice day", "t"), (103, "you i d i o t", "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(80)] + [(1, 0, None), (None, 1, None), (2, None, 1)], "doc_id long, toxic int, text int")
    got = sorted(((r.doc_id, r.predicted) for r in tx.score_toxicity(df, labels).collect() if r.doc_id is None or r.doc_id >= 100), key=str)
    assert got == [(100, 0), (101, 1), (101, 1), (102, 0), (103, 1), (None, 0)]
    assert {r.predicted for r in tx.score_toxicity(df, labels.limit(0)).collect()} == {0}
    assert tx.score_toxicity(df.limit(0), labels).collect() == []


def test_any_number_of_features(spark, monkeypatch):
    """A rare pure word keeps its weight beside more frequent ones, and joined weights score as broadcast ones do."""
    docs = [(i, f"you idiot {'blockhead' if i < 12 else 'fool'} go away" if i % 2 else f"have a nice day {i}") for i in range(80)]
    docs += [(100, "blockhead"), (101, ""), (None, None), (102, "you 1d10t"), (102, "b l o c k h e a d"), (103, "a nice day")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    score = lambda: sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in tx.score_toxicity(df, labels).collect()), key=str)
    want = score()
    monkeypatch.setattr(tx, "FEATURES", 3)
    monkeypatch.setattr(tx, "COUNTED", 10)
    assert score() == want and {p for d, _, _, p in want if d == 100} == {1}


@pytest.mark.parametrize("token, word", [("stuupid", "stupid"), ("idiiot", "idiot"), ("mmoron", "moron"), ("morron", "moron")])
def test_doubled_letters(characters, token, word):
    assert tx.readings(token, characters) == [token, word]


@pytest.mark.parametrize("joiner", [" ", ".", "-", "_"])
def test_words_anywhere_in_a_long_run(characters, joiner, monkeypatch):
    monkeypatch.setattr(tx, "SETTLED", 7)
    letters = "youareanidiotandastupidpersonsoyouseeamoronandanidiot"
    for stray in range(0, 20):
        token = joiner.join("i" * (stray % 2) + "you" * (stray // 2) + letters)
        (run,) = tx.spaced(token.split()) if joiner == " " else [token]
        assert {"idiot", "stupid", "moron"} <= set(tx.readings(run, characters)), token


def test_settling_changes_no_reading(characters, monkeypatch):
    token = "y0u-ar3-@n-1d10t_4nd.a.st*p1d-p3rs*n" * 3
    want = tx.decode(token, characters)
    monkeypatch.setattr(tx, "SETTLED", 2)
    assert tx.decode(token, characters) == want
    assert len(tx.decode("ab1" * 20_000, characters)) >= 40_000


@pytest.mark.parametrize("token", ["*#1#e", "1*1#e", "y*a##e", "st*p1d", "m0r0n"])
def test_viterbi_is_best_as_it_runs(characters, token):
    """Against all readings, with the values that queries run with."""

    def score(text):
        k = [0, 0, *(tx.CLASS.get(c, 0 if c == " " else tx.OTHER) for c in text), 0]
        return sum(float(characters[t]) for t in zip(k, k[1:], k[2:]))

    best = max((sum(w[1] for w in ways) + score(t := "".join(w[0] for w in ways)), t) for ways in itertools.product(*tx.lattice(token)))
    assert tx.decode(token, characters) == best[1]
