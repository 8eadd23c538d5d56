"""Removed word windows against counting every window, with few and with all buckets called crowded."""

import random
from collections import Counter

import pytest

from landshift.llm import substring_dedup as sd
from landshift.llm.automaton import SuffixAutomaton


def brute(rows, window=13):
    texts = [(i if i is not None else 2**63, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            name = tuple(words[k:k + window])
            first[name] = min(first.get(name, i), i)
    out = []
    for (doc, _), (i, words) in zip(rows, texts):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    words = lambda k, v: " ".join(f"w{rng.randrange(v)}" for _ in range(k))
    passages = [words(rng.choice([12, 13, 14, 30, 60]), 3000) for _ in range(10)]
    line = words(9, 50)
    rows = []
    for i in range(n):
        parts = [rng.choice([words(rng.randrange(40), 4000), rng.choice(passages), line, words(30, 3)]) for _ in range(rng.randrange(1, 7))]
        rows.append((rng.randrange(n) if i % 11 else None, " ".join(parts)))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (502, None), (503, " \n"), (504, "é " * 40), (505, "é\x0bé\x1cé " * 20), (1, "é " * 13), (506, "a " * 3000)]


@pytest.mark.parametrize("seed,large,share", [(1, 4096, 0.02), (2, 0, 0.02), (3, 4096, 0.0002)])
def test_mixtures(spark, monkeypatch, seed, large, share):
    monkeypatch.setattr(sd, "LARGE", large)
    monkeypatch.setattr(sd, "POPULAR", share)
    monkeypatch.setattr(sd, "SHARD_WORDS", 300)
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in sd.remove_seen_windows(df).collect())
    assert got == Counter(brute(rows))


def test_automaton():
    rng = random.Random(4)
    sequences = sorted((rng.randrange(30), [rng.randrange(4) for _ in range(rng.randrange(1, 40))]) for _ in range(60))
    automaton = SuffixAutomaton()
    for order, seq in sequences:
        automaton.add(seq, order)
    for window in (1, 3, 6):
        for seq in [s for _, s in sequences[:20]] + [[rng.randrange(5) for _ in range(50)] for _ in range(10)]:
            got = automaton.first_orders(seq, window)
            for i, order in enumerate(got):
                part = seq[i:i + window]
                there = [o for o, s in sequences if any(s[k:k + window] == part for k in range(len(s) - window + 1))]
                assert order == (min(there) if there else None)


def test_empty(spark):
    assert sd.remove_seen_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
