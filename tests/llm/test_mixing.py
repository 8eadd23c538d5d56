"""Raking against a plain loop, calibrated draws, and odd rows."""

import math
from collections import defaultdict

from landshift.llm import mixing
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(tokens, sweeps=200):
    """Fitted shares of {(source, language, topic): tokens} under the tempered targets."""
    fitted = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    for _ in range(sweeps):
        for i, d in enumerate(mixing.DIMENSIONS):
            seen, now = defaultdict(float), defaultdict(float)
            for k, v in tokens.items():
                seen[k[i]] += v
                now[k[i]] += fitted[k]
            part = {v: n ** mixing.TEMPER[d] for v, n in seen.items()}
            fitted = {k: f * part[k[i]] / sum(part.values()) / now[k[i]] if now[k[i]] else 0.0 for k, f in fitted.items()}
    return fitted


def test_query_on_documents(spark):
    rows = QUERIES["op10_mixing"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    tokens, weight, taken, hoped = defaultdict(int), defaultdict(float), 0, 0.0
    for r in rows:
        tokens[r.source, r.language, r.topic] += r.n_tokens
        weight[r.source, r.language, r.topic] += r.weight
        taken, hoped = taken + r.selected, hoped + r.probability
    want = brute(tokens)
    assert all(abs(weight[k] - want[k]) < 2e-3 * max(want.values()) for k in tokens)
    ratio = {k: want[k] / v for k, v in tokens.items()}
    top = max(ratio.values())
    assert all(abs(r.probability - ratio[r.source, r.language, r.topic] / top) < 0.02 for r in rows)
    assert abs(taken - hoped) < 5 * math.sqrt(hoped)


def test_given_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d", "xy"[i % 2], "en") for i in range(200)], "doc_id long, text string, source string, lang string")
    share = {"source": [("x", .8), ("y", .2)], "language": [("en", 1.0)], "topic": [("prose", 1.0)]}
    targets = {d: spark.createDataFrame(v, f"{d} string, target double") for d, v in share.items()}
    got = mixing.mix(docs, targets).collect()
    assert {(r.source, r.probability) for r in got} == {("x", 1.0), ("y", 0.25)}
    assert math.isclose(sum(r.weight for r in got if r.source == "x"), 0.8, rel_tol=1e-6)
    stay = mixing.sample_documents(docs, targets)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in got if r.selected}


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, "", "s", "en", 2), (2, "word " * 9000, "s", None, 3), (2, "word " * 9000, "s", None, 3), (3, " | ", None, "en", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, draw int")
    got = sorted(((r.doc_id, r.source, r.language, r.topic, r.n_tokens) for r in mixing.mix(df).collect()), key=str)
    assert got == sorted([
        (None, "(none)", "(none)", "empty", 0), (1, "s", "en", "empty", 0), (2, "s", "(none)", "prose", 9000),
        (2, "s", "(none)", "prose", 9000), (3, "(none)", "en", "table", 1)], key=str)
    assert mixing.sample_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []


def test_rare_cells_do_not_set_the_kept_share(spark):
    rows = [("a", 600_000, .5), ("b", 400_000, .44), ("rare", 20, .03), ("rarer", 3, .03), ("none", 0, 0.0), ("unwanted", 50_000, 0.0)]
    fitted = spark.createDataFrame(rows, "source string, tokens bigint, fitted double")
    total = sum(r[1] for r in rows)
    for kept, want in ((None, mixing.KEPT), (0.05, 0.05), (0.7, 0.7), (1.0, 1 - 50_000 / total)):
        got = {r.source: r for r in mixing.with_probabilities(fitted, kept).collect()}
        assert math.isclose(sum(r.probability * r.tokens for r in got.values()), want * total, rel_tol=1e-6)
        assert got["rare"].probability == got["rarer"].probability == got["none"].probability == 1 and got["unwanted"].probability == 0
        assert kept == 1.0 or kept == 0.7 or math.isclose(got["b"].probability / got["a"].probability, .44 / 400_000 * 600_000 / .5, rel_tol=1e-4)


def test_one_rare_document_leaves_the_others(spark):
    docs = [(i, "a b c d e f g h i j " * 20, "xy"[i % 7 == 0], "en") for i in range(4000)] + [(9999, "one short text", "z", "fr")]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")).collect()
    assert sum(r.probability * r.n_tokens for r in got) >= 0.999 * mixing.KEPT * sum(r.n_tokens for r in got)
