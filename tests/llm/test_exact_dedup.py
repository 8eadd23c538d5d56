"""Exact deduplication against brute force, with a routing hash of one bit and blocks of a few bytes too."""

import hashlib

import pytest

from landshift.llm.exact_dedup import drop_exact_copies, exact_dedup

SCHEMA = "doc_id long, text string, name string, row int"
TEXTS = ["", None, "a", "a", "ab" * 9, "ab" * 9, "ab" * 9 + "c", "ü" * 11, "ü" * 11, "ba" * 9, "x" * 330, "x" * 330, "x" * 329]
ROWS = [(i, t, "n", 0) for i, t in enumerate(TEXTS)] + [(None, "a", None, None), (3, "a", None, 1), (4, "other", None, 1)]


def expected(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text, *_ in rows:
        ids = [d for d in groups[text or ""] if d is not None]
        out.append((doc, max(ids) if ids else None, len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,bits", [(4096, 64), (64, 64), (16, 1), (30, 2)])
def test_groups(spark, block, bits):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), block_bytes=block, bits=bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(ROWS)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_nulls(spark):
    got = exact_dedup(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.group_size, r.kept) for r in got] == [(None, 1, True)]


def test_kept_rows(spark):
    out = drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert out.columns == ["doc_id", "text", "name", "row"]
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in ROWS})
