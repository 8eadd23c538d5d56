"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from landshift.llm import simhash
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        out |= (ones * 2 > len(grams)) << bit
    return out


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    return [min(groups[root(i)]) for i in range(len(ids))]


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: r for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, p, c in zip(rows, prints, want):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{p:016x}", c)


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_connect_close_prints(spark, monkeypatch, pairwise):
    """Chains two bits apart, a dense cluster in two blocks, and strangers; also with every group looked up."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in [rng.getrandbits(64) for _ in range(3)]:
        p = base
        for _ in range(40):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(p)
        for _ in range(150):
            prints.add(base ^ rng.getrandbits(16))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(s,) for s in signed], "print bigint")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.close_links(nodes).collect()]
    index = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(index[a]), root(index[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == brute_components(list(range(len(prints))), prints)


def test_edges(spark):
    rows = [(5, None), (3, ""), (None, " \n\t"), (9, "One two"), (8, "one  TWO"), (8, "one  TWO"), (None, "Ä ä"), (1, "w " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    want = []
    for i, t in rows:
        p = brute_print(t)
        ids = [j for j, u in rows if j is not None and (brute_print(u) ^ p).bit_count() <= 2]
        want.append((i, f"{p:016x}", min(ids) if ids else None))
    assert got == sorted(want, key=str)
    stay = simhash.drop_near_copies(df)
    assert stay.columns == ["doc_id", "text", "id"]
    assert sorted((r.doc_id for r in stay.collect()), key=str) == [1, 3, 8, None]
    assert simhash.simhash_components(df.limit(0)).collect() == []
