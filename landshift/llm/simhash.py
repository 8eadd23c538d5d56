"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Two 64-bit fingerprints that differ in at most two bits agree on at least six of
eight 8-bit blocks. Every fingerprint therefore meets its partners under the 28 keys
that leave out two blocks, and at most 2**16 different fingerprints can share a key,
however many documents there are. Equal fingerprints are folded to one node first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from landshift.llm.components import connected_components
from landshift.llm.storage import discard, store

SEED = 42
BLOCK_BITS = 8
LEFT_OUT = [(i, j) for i, j in combinations(range(64 // BLOCK_BITS), 2)]
PAIRWISE = 32  # groups up to this size compare all members; larger ones look their neighbours up
FLIPS = np.array([0] + [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)], dtype=np.int64)[1:]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit majority over the XXH64 of all word shingles of the lower-cased text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)][shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(ends))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("data")
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(prints.view(np.int64))], ["id", "key", "print"])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, print) per row; key hashes the text, so that (id, key) names a row even where ids repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "id bigint, key bigint, print bigint")


def _free_bits(prints: np.ndarray, left_out: tuple[int, int]) -> np.ndarray:
    i, j = left_out
    low = (prints >> np.uint64(BLOCK_BITS * i)) & np.uint64(255)
    return (low | (((prints >> np.uint64(BLOCK_BITS * j)) & np.uint64(255)) << np.uint64(8))).astype(np.int64)


def spanning_links(prints: np.ndarray, left_out: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs at distance 2 or less connect, one per member at most.

    All members agree outside the two blocks left out, so the 136 fingerprints within
    two flips of a member are looked up in a table of 2**16 places.
    """
    free = _free_bits(prints, left_out)
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[free] = np.arange(len(prints))
    label = np.arange(len(prints))
    while True:
        low = label.copy()
        for flip in FLIPS:
            near = place[free ^ flip]
            there = near >= 0
            low[there] = np.minimum(low[there], label[near[there]])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _pairwise(group: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for shift in range(1, PAIRWISE):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            return
        close = same[np.bitwise_count(prints[same] ^ prints[same + shift]) <= 2]
        yield prints[close], prints[close + shift]


def _grouped_links(combo: np.ndarray, key: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    new = np.flatnonzero((np.diff(combo) != 0) | (np.diff(key) != 0)) + 1
    starts = np.concatenate([[0], new])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    some = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    yield from _pairwise(group[some], prints[some])
    for g in np.flatnonzero(sizes > PAIRWISE):
        members = slice(starts[g], starts[g] + sizes[g])
        yield spanning_links(prints[members], LEFT_OUT[combo[starts[g]]])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal keys; the last run of a batch waits for the next one. A run holds 2**16 rows at most."""
    held = [np.empty(0, np.int64)] * 3

    def out(columns):
        for a, b in _grouped_links(columns[0], columns[1], columns[2].view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("combo", "masked", "print")]
        rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield from out([r[:cut] for r in rows])
    if len(held[0]):
        yield from out(held)


def close_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all pairs at distance 2 or less."""
    masks = []
    for i, j in LEFT_OUT:
        mask = (1 << 64) - 1 - (255 << BLOCK_BITS * i) - (255 << BLOCK_BITS * j)
        masks.append(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    keyed = prints.select("print", F.posexplode(F.array(*masks)).alias("combo", "mask")).select(
        F.col("combo").cast("bigint"), F.col("print").bitwiseAND(F.col("mask")).alias("masked"), "print"
    )
    return keyed.repartition("combo", "masked").sortWithinPartitions("combo", "masked", "print").mapInArrow(_links, "a bigint, b bigint")


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fingerprint, component_id, root) per row.

    component_id is the smallest id reachable over links of 2 or fewer differing bits,
    the row's own included; null where no row of the component has an id. root, a
    fingerprint, names the component even then. Null and empty texts and texts of white
    space have fingerprint zero. An empty table gives an empty result.
    """
    rows = store(fingerprints(documents, id_col, text_col, shingle))
    nodes = store(rows.groupBy("print").agg(F.min("id").alias("least")))
    links = store(close_links(nodes.select("print")))
    reached = connected_components(links)
    rooted = store(nodes.join(reached.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    least = store(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = store(rooted.join(least, "root").select("print", "root", "component_id"))
    discard(links, nodes, rooted, least)
    return rows.join(named, "print").select(
        F.col("id").alias(id_col), "key", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of `documents`, all columns, that stay when each component keeps its smallest id (null ids last)."""
    # columns get numbers for names, so that none of the input's clashes with those used here
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    id_name, text = names[id_col], F.col(names[text_col])
    found = store(simhash_components(rows, id_name, names[text_col], shingle).withColumnRenamed(id_name, "_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("key").alias("key"))
    stay = store(found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.key").alias("_key")))
    there = rows.withColumn("_text_key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    out = there.join(stay, F.col(id_name).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    if not found.groupBy("_id", "key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_name, "_text_key"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
