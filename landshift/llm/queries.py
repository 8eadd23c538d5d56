"""Registered queries of the pipeline operators, each with its reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.llm.alignment import align_tokenizers
from landshift.llm.bpe import encode_decode
from landshift.llm.exact_dedup import exact_dedup
from landshift.llm.language_id import identify_languages
from landshift.llm.licenses import scan_licenses
from landshift.llm.merkle import merkle_manifest
from landshift.llm.mixing import mix
from landshift.llm.partenum import jaccard_components
from landshift.llm.simhash import simhash_components
from landshift.llm.substring_dedup import remove_seen_windows
from landshift.llm.suffix_dedup import remove_repeats
from landshift.llm.topk import quantised, top_k
from landshift.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op4_bpe_encode_decode")
def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", "n_tokens", F.lower(F.sha2("ids", 256)).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_top_k_search", """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op8_substring_dedup", r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS name FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), firsts AS (
  SELECT name, min(doc_id) AS first FROM windows GROUP BY name
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (name) WHERE doc_id > first
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) a
  ANTI JOIN gone USING (doc_id, i) GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_seen_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("licenses").alias("n_licenses"), F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join("licenses.template", ",").alias("templates"), F.to_json("licenses").alias("licenses"),
    )


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokenizers(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op13_merkle_manifest", """
WITH RECURSIVE d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
         list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, xor(crc, 4294967295) % 5 = 0 AS tampered,
         sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
           coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
           coalesce(strlen(lower_text) || ':' || lower_text, '-'))) AS changed
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, i // 16
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, n, i // 16
), fold AS (
  SELECT tree, i AS leaf_i, 0 AS level, i, n, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT f.tree, leaf_i, f.level + 1, f.i // 16, (f.n + 15) // 16, sha256(string_agg(CASE WHEN x.i = f.i THEN f.h ELSE x.h END, '' ORDER BY x.i))
  FROM fold f JOIN nodes x ON x.tree = f.tree AND x.level = f.level AND x.i // 16 = f.i // 16
  WHERE f.n > 1 GROUP BY f.tree, leaf_i, f.level, f.n, f.i // 16
), upper_fold AS (
  SELECT f.tree, leaf_i, 0 AS level, s.i, s.n, f.h FROM fold f JOIN subroots s USING (tree) WHERE f.n = 1
  UNION ALL
  SELECT f.tree, leaf_i, f.level + 1, f.i // 16, (f.n + 15) // 16, sha256(string_agg(CASE WHEN x.i = f.i THEN f.h ELSE x.h END, '' ORDER BY x.i))
  FROM upper_fold f JOIN upper_nodes x ON x.level = f.level AND x.i // 16 = f.i // 16
  WHERE f.n > 1 GROUP BY f.tree, leaf_i, f.level, f.n, f.i // 16
), steps AS (
  SELECT p.tree, p.i AS leaf_i, x.level, x.i, x.h FROM placed p JOIN nodes x
    ON x.tree = p.tree AND x.n > 1 AND x.i // 16 = p.i // CAST(16 ** (x.level + 1) AS BIGINT) AND x.i <> p.i // CAST(16 ** x.level AS BIGINT)
  UNION ALL
  SELECT p.tree, p.i, 100 + x.level, x.i, x.h FROM placed p JOIN subroots s ON s.tree = p.tree JOIN upper_nodes x
    ON x.n > 1 AND x.i // 16 = s.i // CAST(16 ** (x.level + 1) AS BIGINT) AND x.i <> s.i // CAST(16 ** x.level AS BIGINT)
), proofs AS (
  SELECT tree, leaf_i, sha256(string_agg(h, '' ORDER BY level, i)) AS proof FROM steps GROUP BY tree, leaf_i
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN upper_fold f ON f.tree = p.tree AND f.leaf_i = p.i AND f.n = 1
JOIN upper_nodes r ON r.n = 1 LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_i = p.i
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query("op11_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
""")
def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
