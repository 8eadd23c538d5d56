"""License scans: lines of the documents, altered copies, and alignment against full dynamic programming."""

import random

import numpy as np
import pytest

from landshift.llm import licenses as li
from landshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
LINES = {"mit-line", "apache-line", "gpl-line", "cc-by-nc-line", "reserved-line"}


def test_query_on_documents(spark):
    """Every document that holds a license line, word for word, is reported with it; no other is."""
    norm = lambda t: " " + " ".join(filter(None, ("".join(filter(str.isalnum, w)) for w in t.lower().split()))) + " "
    texts = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: set(r.templates.split(",")) - {""} for r in QUERIES["op9_license_scan"](spark, SF).collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        assert {n for n in LINES if norm(li.TEMPLATES[n]) in text} == got[doc] & LINES
    assert any(got.values())


@pytest.mark.parametrize("name", ["mit", "bsd", "apache", "gpl", "isc"])
def test_altered_copies(name):
    rng, index = random.Random(7), li.TemplateIndex(li.TEMPLATES)
    words = li.TEMPLATES[name].split()
    for edits in (0, 2, 4):
        copy = list(words)
        for _ in range(edits):
            at = rng.randrange(len(copy))
            copy[at:at + 1] = rng.choice([[], ["changed"], [copy[at], "extra"]])
        text = " ".join(["before"] * 50 + copy + ["after"] * 30).upper()
        found = li.scan(text, index)
        assert [f["template"] for f in found] == [name]
        assert found[0]["start"] >= 50 and found[0]["end"] <= 50 + len(copy) and found[0]["coverage"] >= 1 - 2.5 * edits / len(words)
    assert [f["start"] for f in li.scan(" ".join(words + ["x"] * 5 + words), index)] == [0, len(words) + 5]
    half = words[:len(words) // 2]
    assert all(f["template"].endswith("-line") for f in li.scan(" ".join(half), index))


def test_alignment_in_a_wide_band_is_local_alignment():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 14))], dtype=np.uint64) for _ in range(2))
        cells, best = {}, 0
        for i in range(len(a)):
            for j in range(len(b)):
                up, left, corner = cells.get((i - 1, j), 0), cells.get((i, j - 1), 0), cells.get((i - 1, j - 1), 0)
                cells[i, j] = corner + 1 if a[i] == b[j] else max(0, max(up, left, corner) - 1)
                best = max(best, cells[i, j])
        matched, start, end = li.align(a, b, 0, 0, 40)
        assert (matched > 0) == (best > 0) and matched >= best and 0 <= start <= end <= len(b)


@pytest.mark.parametrize("name", [n for n in li.TEMPLATES if n.endswith("-line")])
def test_each_word_of_a_line_changed(name):
    """One changed word, anywhere, leaves a line reported as long as the rest covers enough of it."""
    index, words = li.TemplateIndex(li.TEMPLATES), li.TEMPLATES[name].split()
    for at in range(len(words)):
        text = " ".join(["before"] * 5 + words[:at] + ["changed"] + words[at + 1:] + ["after"] * 5)
        found = {f["template"]: f for f in li.scan(text, index)}
        if len(words) - 1 < li.LEAST * len(words):
            assert name not in found
        elif name in found:
            assert found[name]["matched"] == len(words) - 1
        else:  # a line with other words in the changed place covers the same words as well
            assert any(f["matched"] >= len(words) - 1 for f in found.values())


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 50, 200).astype(np.uint64)
    picked = li.winnow(hashes)
    assert max(np.diff([-1, *picked, 200])) <= li.WINNOW


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "MIT"), (4, "All rights reserved. " * 3), (4, "all RIGHTS, reserved!"), (5, "word " * 20000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")
    got = sorted((str(r.doc_id), len(r.licenses)) for r in li.scan_licenses(df).collect())
    assert got == [("1", 0), ("2", 0), ("3", 0), ("4", 1), ("4", 3), ("5", 0), ("None", 0)]
    assert li.scan_licenses(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        li.TemplateIndex({"big": "w " * (li.INDEX_WORDS + 1)})
