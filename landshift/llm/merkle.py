"""Merkle manifest of a dataset: roots, and for every row the proof that it is part of them.

Rows are leaves of one tree per source, and the roots of the sources are leaves of one more
tree. The leaves of a source are cut into aligned blocks of `fanout` squared, each of which
hashes its own subtree. Blocks then take part in a butterfly exchange: in each round, the blocks
that stand at the same place of up to `fanout` neighbouring subtrees swap the roots of these
subtrees and every one of them hashes the common ancestor itself. So a block holds all upper
siblings when the last round ends, no group has more than `fanout` rows, and nothing is sent
back down the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.storage import discard, store
from landshift.operators.ranking import row_numbers

FANOUT = 16
DEPTH = 2  # levels that a block hashes by itself
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    return F.lower(F.sha2(F.concat(*map(_field, values)), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def block_levels(leaves: list[str], alone: bool, fanout: int) -> list[list[str]]:
    """The leaves and the levels above them: up to one node if the block is its whole tree, else DEPTH levels."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= DEPTH:
        below = levels[-1]
        levels.append([_hash(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _roots(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alone, inner = [], []
        for rows in batch.column("rows").to_pylist():
            leaves = [r["leaf"] for r in rows]
            alone.append(block_levels(leaves, True, fanout)[-1][0])
            inner.append(block_levels(leaves, False, fanout)[-1][0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone, pa.string()), pa.array(inner, pa.string())],
                                         [*batch.schema.names, "root_alone", "root_inner"])


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, index, path, top) from (tree, index, n, digest), the n bottom nodes of each tree.

    `path` has one entry per level: the place of the node's ancestor among its siblings, and
    their digests (`others`, in order). `top` is the root of the tree. A last subtree that
    has fewer nodes than its neighbours sends its root to the groups it has no node for, too.
    """
    siblings = "array<struct<place:int,others:array<string>>>"
    state = store(nodes.select("tree", "index", "n", F.col("digest").alias("top"), F.array().cast(siblings).alias("path")))
    most = state.agg(F.max("n")).first()[0] or 0
    span, done = 1, []
    while span < most:
        done.append(state.where(F.col("n") <= span))
        place = (F.floor(F.col("index") / span) % fanout).cast("int")
        first = F.floor(F.col("index") / span) * span
        width = F.least(F.lit(span).cast("bigint"), F.col("n") - first)
        own = F.col("index") % span
        # with neighbours to its left, all of which are full, a subtree serves every offset
        last = F.when(place > 0, F.lit(span - 1).cast("bigint")).otherwise(own)
        sent = state.where(F.col("n") > span).select(
            "tree", F.floor(F.col("index") / (span * fanout)).alias("run"), F.explode(F.sequence(own, last, width)).alias("offset"),
            own.alias("own"), F.struct(place.alias("place"), F.col("top").alias("digest")).alias("said"), "index", "n", "path",
        ).withColumn("member", F.when(F.col("offset") == F.col("own"), F.struct("index", "n", "path", F.col("said.place").alias("place"))))
        met = sent.groupBy("tree", "run", "offset").agg(
            F.sort_array(F.collect_list("said")).alias("swapped"), F.collect_list("member").alias("members"))
        each = met.select("tree", "swapped", F.explode("members").alias("m"))
        others = F.transform(F.filter("swapped", lambda s: s["place"] != F.col("m.place")), lambda s: s["digest"])
        after = store(each.select(
            "tree", F.col("m.index").alias("index"), F.col("m.n").alias("n"),
            F.lower(F.sha2(F.array_join(F.transform("swapped", lambda s: s["digest"]), ""), 256)).alias("top"),
            F.concat("m.path", F.array(F.struct(F.col("m.place").alias("place"), others.alias("others")))).alias("path")))
        state, span = after, span * fanout
    for part in done:
        state = state.unionByName(part)
    return state.select("tree", "index", "path", "top")


def _prove(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "leaf", "subroot", "root", "proof", "folded_root"]
    kinds = [pa.int64(), *[pa.string()] * 5]
    for batch in batches:
        for block in batch.to_pylist():
            levels = block_levels([r["leaf"] for r in block["rows"]], block["alone"], fanout)
            upper = [(p["others"][:p["place"]], p["others"][p["place"]:]) for p in [*block["path"], *block["source_path"]]]
            tail = "".join("".join(before + after) for before, after in upper)
            parents: dict[tuple[int, int, str], str] = {}
            rows = []
            for i, r in enumerate(block["rows"]):
                proof, digest, at = [], r["tampered"] or r["leaf"], i
                for number, level in enumerate(levels[:-1]):
                    start = at - at % fanout
                    before, after = level[start:at], level[at + 1:start + fanout]
                    proof += before + after
                    if (number, at, digest) not in parents:
                        parents[number, at, digest] = _hash([*before, digest, *after])
                    digest, at = parents[number, at, digest], at // fanout
                for number, (before, after) in enumerate(upper, len(levels)):
                    if (number, 0, digest) not in parents:
                        parents[number, 0, digest] = _hash([*before, digest, *after])
                    digest = parents[number, 0, digest]
                rows.append((r["id"], r["leaf"], block["subroot"], block["root"], "".join(proof) + tail, digest))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def merkle_manifest(documents: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                    tree_col: str = "source", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) per row of `documents`.

    `proof` is the siblings' digests, level by level through the source's tree and the tree of
    sources, left to right, in one string; `folded_root` is hashed from the leaf and its proof;
    where `tampered` holds, from the leaf of the row with A-Z of its text in lower case instead,
    and `verified` says whether it equals the root. Null and empty values have different leaves.
    Rows with a null source are a tree of their own, the first. Of equal ids, and of null ids,
    which come first, the smaller leaf is first; equal rows have equal leaves and proofs of their
    own places. Other columns are not read. An empty table gives an empty result.
    """
    values = [F.col(f) for f in fields]
    flag = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    changed = leaf_hash(*[lower_ascii(v.cast("string")) if f == text_col else v for f, v in zip(fields, values)])
    leaves = store(documents.select(
        # a source is told from null by a sign before it, which keeps the order of its bytes
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).cast("bigint").alias("id"), leaf_hash(*values).alias("leaf"), F.when(flag, changed).alias("tampered")))
    size = fanout**DEPTH
    placed = row_numbers(leaves, ["tree"], ["id", "leaf", "tampered"], "place")
    blocks = placed.groupBy("tree", F.floor((F.col("place") - 1) / size).alias("index")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "tampered"))).alias("rows"))
    row = "array<struct<place:bigint,id:bigint,leaf:string,tampered:string>>"
    blocks = store(blocks.mapInArrow(
        lambda it: _roots(it, fanout), f"tree string, index bigint, rows {row}, root_alone string, root_inner string"))
    counts = blocks.groupBy("tree").agg((F.max("index") + 1).alias("n"))
    digest = F.when(F.col("n") == 1, F.col("root_alone")).otherwise(F.col("root_inner")).alias("digest")
    upper = store(butterfly(blocks.join(counts, "tree").select("tree", "index", "n", digest), fanout))
    sources = row_numbers(upper.where("index = 0").select("tree", F.col("top").alias("digest")), [], ["tree"], "place")
    above = butterfly(sources.select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("index"), F.lit(sources.count()).cast("bigint").alias("n"), "digest"), fanout)
    named = store(sources.select("tree", (F.col("place") - 1).alias("index")).join(
        above.select("index", F.col("path").alias("source_path"), F.col("top").alias("root")), "index").drop("index"))
    ready = blocks.join(upper, ["tree", "index"]).join(counts, "tree").join(named, "tree").select(
        "rows", (F.col("n") == 1).alias("alone"), "path", "source_path", F.col("top").alias("subroot"), "root")
    out = ready.mapInArrow(lambda it: _prove(it, fanout),
                           "id bigint, leaf string, subroot string, root string, proof string, folded_root string")
    discard(leaves)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)
