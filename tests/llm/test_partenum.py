"""Signatures, links and components against brute force."""

import random

import numpy as np
import pytest

from landshift.llm import partenum as pe
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def grams(text, width=3):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=90, width=3):
    """Sorted (id, size, component) of rows (id, text)."""
    sets = [grams(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def found(df, **kwargs):
    return sorted((tuple(r) for r in pe.jaccard_components(df, **kwargs).collect()), key=str)


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_ngram_jaccard_join"](spark, SF).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_similar_sets_share_a_signature(percent):
    """Pairs right at the threshold, of sizes from 1 to 4000, of equal and of different size."""
    rng = np.random.default_rng(percent)
    bands = pe.Bands(percent)
    for size in [1, 2, 5, 9, 10, 11, 12, 19, 20, 25, 40, 75, 76, 77, 90, 120, 300, 301, 999, 4000]:
        for _ in range(30):
            union = size + int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))
            both = -(-union * percent // 100)
            all_of = rng.integers(0, 1 << 64, union, dtype=np.uint64)
            cut = int(rng.integers(0, union - both + 1))  # elements only the first set has
            first, second = all_of[:both + cut], np.concatenate([all_of[:both], all_of[both + cut:]])
            assert np.intersect1d(pe.signatures(first, bands), pe.signatures(second, bands)).size


def test_unlike_sets_seldom_share_one():
    rng = np.random.default_rng(0)
    bands = pe.Bands()
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    marks = [pe.signatures(np.concatenate([base[:150], rng.integers(0, 1 << 64, 150, dtype=np.uint64)]), bands) for _ in range(60)]
    shared = sum(np.intersect1d(a, b).size > 0 for i, a in enumerate(marks) for b in marks[:i])
    assert shared < 60 * 59 / 2 * 0.05


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("hubs, pairs", [(8, 1024), (1, 2)])
def test_chains_clouds_and_strangers(spark, monkeypatch, hubs, pairs):
    """Chains of copies whose ends are unlike, a dense cloud, texts that share most words but stay below the threshold; also with one hub a round."""
    monkeypatch.setattr(pe, "HUBS", hubs)
    monkeypatch.setattr(pe, "PAIRS", pairs)
    rng = random.Random(hubs)
    rows = []
    for n in (12, 200):
        text = words(rng, n)
        for _ in range(8):  # each step changes one place in a hundred words or so
            for _ in range(max(1, n // 100)):
                text[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    base = words(rng, 150)
    for _ in range(12):
        rows.append(" ".join([*base[:75], f"c{rng.randrange(10**6)}", *base[76:]]))
    for _ in range(8):  # three changes lie far enough apart to lose nine shingles each side
        text = list(base)
        for at in rng.sample(range(5, 145, 5), 4):
            text[at] = f"d{rng.randrange(10**6)}"
        rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("percent, width", [(90, 3), (80, 5)])
def test_edges(spark, percent, width):
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "one two"), (None, "Ä b c d"), (7, "ä b c d"), (8, "same " * 50),
            (9, "same " * 60), (10, long), (11, long + " end"), (0, "a b c"), (12, "a b c d"), (13, "x\x1cy z w"), (14, "x\x1cy z w q r"), (15, "b c a b c a b c a b"), (16, "c a b c a b c a")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, sig int")
    assert found(df, percent=percent, width=width) == brute(rows, percent, width)
    assert found(df.limit(0)) == []


def test_cloud_below_the_threshold_is_not_compared_pair_by_pair(spark, monkeypatch):
    """160 texts that share most n-grams, but too few for a link, and four real copies among them."""
    compared = []
    verified = pe._verified

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(pe, "_verified", counting)
    rng = random.Random(7)
    base = words(rng, 200)
    rows = []
    for _ in range(160):
        text = list(base)
        for at in rng.sample(range(200), 12):
            text[at] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(text))
    rows += [f"{text} last" for text in rows[:4]]
    rows = list(enumerate(rows))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert sum(compared) < 12 * len(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(3)
    for size in (1, 50, 2_000, 50_000):
        both = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for apart in (0, 1, 7, 300):
            a, b = (np.concatenate([both, rng.integers(0, 1 << 64, n, dtype=np.uint64)]) for n in (apart // 3, apart - apart // 3))
            turned = int(np.bitwise_count((pe.bitmap(a) ^ pe.bitmap(b)).view(np.uint64)).sum())
            assert turned <= apart and (apart - turned) % 2 == 0 and (apart < 300 or turned > 150)


@pytest.mark.parametrize("words_of_bits", [16, 1])
def test_cloud_just_below_the_threshold_is_not_compared_pair_by_pair(spark, monkeypatch, words_of_bits):
    """Each of 160 texts is near enough to their common base for a link, but no two to each other, so the places of what they share exclude nothing."""
    compared = []
    verified = pe._verified

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(pe, "_verified", counting)
    monkeypatch.setattr(pe, "WORDS", words_of_bits)  # a small bitmap excludes less and changes no result
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(160):
        text = list(base)
        for at in rng.sample(range(5, 395, 5), 6):
            text[at] = f"f{rng.randrange(10**9)}"
        rows.append(" ".join(text))
    rows += [f"{text} last" for text in rows[:4]]
    rows = list(enumerate(rows))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    if words_of_bits == 16:
        assert sum(compared[1:]) < 2 * len(rows)  # after the first round, whose pairs per row are bounded
