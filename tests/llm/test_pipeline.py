"""The pipeline against its stages done in plain Python."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from landshift.llm import mixing

from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage's decisions take effect, on all that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "encoding"]

    def after(name, before):
        out = stages[name](spark, spark.createDataFrame(before, docs.schema), SF)
        assert name == "encoding" or out.columns == docs.columns
        rows = out.collect()
        assert name == "encoding" or all(all_rows[r.doc_id] == r for r in rows)
        return rows

    kept = after("language_id", list(all_rows.values()))
    assert len(kept) >= 0.98 * len(all_rows) and all(any(map(str.isalpha, r.text)) for r in kept)

    last = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        last[r.text] = r.doc_id
    distinct = after("exact_dedup", kept)
    assert {r.doc_id for r in distinct} == set(last.values())

    ids = [r.doc_id for r in distinct]
    component = brute_components(ids, [brute_print(r.text) for r in distinct])
    near = after("near_dedup", distinct)
    assert sorted(r.doc_id for r in near) == sorted(set(component))

    drawn = after("mixing", near)
    selected = {r.doc_id for r in mixing.mix(spark.createDataFrame(near, docs.schema)).collect() if r.selected}
    assert {r.doc_id for r in drawn} == selected and drawn

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = {r.doc_id: r for r in after("encoding", drawn)}
    assert set(coded) == selected
    for r in drawn:
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert list(memoryview(bytes(coded[r.doc_id].ids)).cast("I")) == ids
        assert coded[r.doc_id].decoded == tok.decode(ids, skip_special_tokens=False)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
