"""Roots, proofs and folded roots against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from landshift.llm import merkle
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def walk(tree, at, digest, fanout):
    proof = []
    for level in tree[:-1]:
        start = at - at % fanout
        run = level[start:start + fanout]
        proof += run[:at - start] + run[at - start + 1:]
        digest = h([*run[:at - start], digest, *run[at - start + 1:]])
        at //= fanout
    return proof, digest


def brute(rows, fanout):
    """rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded_root)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by_source[s]], fanout)
    top = levels([trees[s][-1][0] for s in order], fanout)
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest = leaf((*r[:4], lower(r[4]))) if tampered else leaf(r)
            low, digest = walk(trees[s], i, digest, fanout)
            high, digest = walk(top, n, digest, fanout)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], "".join(low + high), digest))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    want = {w[0]: w for w in brute([tuple(r) for r in rows], 16)}
    got = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r) == (*w[:4], h([w[4]]), w[5], w[5] == w[3])
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


@pytest.mark.parametrize("fanout", [2, 3])
def test_exchange_over_many_blocks(spark, fanout):
    """Trees of 1 to 300 leaves, more of them than the fanout, with last runs of every length."""
    rows = [(1000 * s + i, f"s{s}", "en", i, f"Text {i % 5}") for s, n in enumerate([1, 2, 3, 4, 5, 8, 9, 10, 17, 28, 82, 100, 300]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = merkle.merkle_manifest(df, tampered(), fanout=fanout).drop("verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, fanout)


def test_edges(spark):
    """Nulls anywhere, empty values, repeated rows and ids, sources that differ in bytes only, a very long text, clashing columns."""
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (5, "a", "en", 1, "A"), (5, "a", "en", 1, "B"),
            (7, "é", "en", 3, "É Z"), (8, "=", None, 1, "q" * 100_000), (9, "ｚ", "xx", 2, "-"), (10, "😀", "xx", 2, "1:a")]
    df = spark.createDataFrame([(*r, "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string")
    out = merkle.merkle_manifest(df, tampered())
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert sorted((tuple(r)[:6] for r in out.collect()), key=str) == brute(rows, 16)
    one = merkle.merkle_manifest(df.where("doc_id = 9")).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof == "" and one[0].verified
    assert merkle.merkle_manifest(df.limit(0)).collect() == []
