"""Repeated byte strings against counting every string."""

import hashlib
import random
from collections import Counter

import pytest

from landshift.llm.queries import QUERIES
from landshift.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    counts = Counter(hashlib.md5(d[i:i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[hashlib.md5(d[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert len(got) == len(rows)
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_mixtures(spark, seed):
    """Passages around the threshold, edits, periods, shared starts and ends, overlaps, non-ASCII text."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(rng.choice([398, 399, 400, 401, 460, 900, 2000])) for _ in range(12)]
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "ab" * 700, word(390) * 4, "x" * 2500]
    for _ in range(40):
        parts = [rng.choice([word(rng.randrange(0, 300)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))]
        text = "".join(parts)
        if rng.random() < .4 and text:
            i = rng.randrange(len(text))
            text = text[:i] + "#" + text[i + rng.randrange(2):]
        texts.append(text)
    texts += [texts[-1], texts[-2][:700], passages[0], passages[0]]
    rows = [(i if i % 9 else None, t, "x", b"y") for i, t in enumerate(texts)] + [(3, "z" * 10, "x", b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, data binary").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(df).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=100)
