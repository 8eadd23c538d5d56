"""The forward algorithm against all segmentations, and held-out accuracy."""

import math
import zlib

import numpy as np
import public_tokenizers

from landshift.llm import language_id as li
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, table):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in table or (k == 1):
            for rest in segmentations(word[k:], table):
                yield [word[:k], *rest]


def brute(word, names, probs, language):
    table = {p: probs[i, language] for i, p in enumerate(names)}
    return sum(math.prod(table.get(p, li.UNSEEN) for p in s) for s in segmentations(word, table))


def test_sum_over_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((len(names), 2)) / 9, [li.UNSEEN] * 2])
    words = ["a", "ab", "abab", "xaba", "é", "abababab"]
    got = np.exp(li.log_likelihood(words, li.Pieces(names), probs))
    for i, w in enumerate(words):
        for language in (0, 1):
            assert math.isclose(got[i, language], brute("▁" + w, names, probs, language), rel_tol=1e-9)


def test_expected_counts():
    names = ["▁", "a", "b", "ab", "▁a"]
    probs = np.vstack([np.array([[.2, .1], [.3, .2], [.1, .3], [.2, .2], [.2, .2]]), [li.UNSEEN] * 2])
    words, weights, language = ["ab", "aab", "b"], np.array([2.0, 1.0, 3.0]), np.array([0, 1, 1])
    want = np.zeros(probs.shape)
    for w, n, lang in zip(words, weights, language):
        table = {p: probs[i, lang] for i, p in enumerate(names)}
        ways = [(math.prod(table[p] for p in s), s) for s in segmentations("▁" + w, table) if all(p in table for p in s)]
        for p, s in ways:
            for piece in s:
                want[names.index(piece), lang] += n * p / sum(q for q, _ in ways)
    got = li.expected_counts(words, weights, language, li.Pieces(names), probs)
    assert np.allclose(got, want, atol=1e-6)


def test_long_words_are_summed_whole(monkeypatch):
    """Words on either side of the limit, summed both ways, and a word far beyond the range of a double."""
    names = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bbbb"]
    rng = np.random.default_rng(2)
    probs = np.vstack([rng.random((len(names), 3)) / 9, [li.UNSEEN] * 3])
    words = ["".join(rng.choice(list("abx"), n, p=[.5, .45, .05])) for n in (3, 30, 38, 39, 40, 41, 60)] + ["ab" * 20, "x"]
    weights, language = rng.random(len(words)), rng.integers(0, 3, len(words))
    pieces = li.Pieces(names)
    monkeypatch.setattr(li, "SHORT", 100)
    together, counts = li.log_likelihood(words, pieces, probs), li.expected_counts(words, weights, language, pieces, probs)
    monkeypatch.setattr(li, "SHORT", 0)
    assert np.allclose(li.log_likelihood(words, pieces, probs), together, rtol=1e-12)
    assert np.allclose(li.expected_counts(words, weights, language, pieces, probs), counts, rtol=1e-9)
    monkeypatch.undo()
    assert np.allclose(li.log_likelihood(words, pieces, probs), together, rtol=1e-12)
    assert np.isfinite(li.log_likelihood(["ab" * 5000], pieces, probs)).all()


def test_query_against_the_definition(spark):
    """Scores of whole texts from the model's probabilities, piece by piece, with words that no cut may change."""
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the hund", None), ("catdogcatdogcatdogcatdogcatdogcatdogcatdog", None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df.where("lang is not null").select("lang", "text"), PATH)
    names = li.vocabulary_pieces(PATH)
    tables = [dict(zip(names, model.probs[:-1, j])) for j in range(2)]
    got = {r.doc_id: r for r in li.predict(df, model, [df.doc_id]).collect()}
    for i, text, _ in rows:
        logs = []
        for table in tables:
            total = 0.0
            for word in text.split():
                word, forward = "▁" + word, [1.0]
                for end in range(1, len(word) + 1):
                    ways = [forward[a] * table[word[a:end]] for a in range(end) if word[a:end] in table]
                    if word[end - 1] not in table:
                        ways.append(forward[end - 1] * li.UNSEEN)
                    forward.append(sum(ways))
                total += math.log(forward[-1])
            logs.append(total)
        best = max(logs)
        assert got[i].lang_pred == model.languages[logs.index(best)]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - best) for x in logs), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    tested = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in tested)
    assert right / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en", 0) for i in range(9)] + [(i + 9, "der hund und die katze", "de", 0) for i in range(9)]
    rows += [(None, None, "en", 1), (100, "", None, 1), (101, "123 !!", "de", 1), (102, "hund" * 4000, None, 1), (102, "the dog", None, 1), (103, "日本", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred) for r in li.identify_languages(df, PATH).collect()]
    assert len(got) == len(rows)
    assert {(None, "und"), (100, "und"), (101, "und"), (102, "de"), (102, "en")} <= set(got)
    kept = li.keep_identified(df, PATH)
    assert kept.columns == df.columns and kept.where("text is null or text = '' or doc_id = 101").count() == 0
    assert li.identify_languages(df.limit(0), PATH).collect() == []
    assert {r.lang_pred for r in li.identify_languages(df.withColumn("lang", df.lang.substr(9, 1)).where("false"), PATH).collect()} == set()
