"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks of bytes. Equal blocks meet in one place,
are sorted and numbered, and every block is replaced by its integer; then adjacent
pairs of integers are named in the same way until one integer per document is
left. Equal integers after equally many rounds mean equal texts, whatever hash
values say: a hash only routes a content to its number, and contents that share
a hash are looked up by content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.storage import store

BLOCK_BYTES = 4096


def _hash(content: Sequence[str], bits: int) -> Column:
    h = F.xxhash64(*content)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def with_names(rows: DataFrame, content: Sequence[str], keep: Sequence[str], bits: int = 64) -> DataFrame:
    """`keep` columns of `rows` plus `name`, an integer that two rows share exactly if their `content` is equal.

    Contents cross the network once, folded inside each task before. Rows then
    fetch their number by hash alone; a popular content is a skewed join key with
    a plain table on either side, which Spark splits at run time.
    """
    keyed = rows.withColumn("_h", _hash(content, bits))
    distinct = keyed.select("_h", *content).distinct().sortWithinPartitions("_h", *content)
    numbers = store(distinct.select("_h", F.monotonically_increasing_id().alias("name")))
    shared = numbers.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    if shared.isEmpty():
        return keyed.select(*keep, "_h").join(numbers, "_h").drop("_h")
    # contents that share a hash: numbered by content, with negative numbers so that no other name is met
    shared = store(shared)
    clashing = store(
        keyed.join(shared, "_h", "left_semi").select("_h", *content).distinct()
        .withColumn("name", -1 - F.monotonically_increasing_id())
    )
    alone = keyed.select(*keep, "_h").join(numbers.join(shared, "_h", "left_anti"), "_h").drop("_h")
    met = keyed.join(shared, "_h", "left_semi").join(clashing, ["_h", *content]).select(*keep, "name")
    return alone.unionByName(met)


def document_identities(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row per input row: row, id, digest (SHA-256 of the UTF-8 bytes), rounds and name; equal texts share (rounds, name).

    Null texts count as empty; an empty text has one empty block. `bits` shortens
    the routing hash, for tests of contents that share it.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    cut = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), data.alias("data"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    occurrences = cut.select(
        "row", "id", F.unhex(F.sha2("data", 256)).alias("digest"), count.alias("left"), F.posexplode(blocks).alias("at", "block")
    )
    kept = ["row", "id", "digest", "left", "at"]
    state, rounds, done = store(with_names(occurrences, ["block"], kept, bits)), 0, []
    while True:
        done.append(state.where("left = 1").select("row", "id", "digest", F.lit(rounds).alias("rounds"), "name"))
        if state.where("left > 1").isEmpty():
            break
        even = F.col("at") % 2 == 0
        pairs = state.where("left > 1").groupBy("row", F.shiftright("at", 1).alias("at")).agg(
            F.max("id").alias("id"), F.max("digest").alias("digest"), F.ceil(F.max("left") / 2).cast("int").alias("left"),
            F.max(F.when(even, F.col("name"))).alias("first"), F.max(F.when(~even, F.col("name"))).alias("second"),
            F.max(F.when(even, F.lit(False)).otherwise(True)).alias("paired"),
        ).withColumn("second", F.coalesce("second", F.lit(0)))
        state = store(with_names(pairs, ["first", "second", "paired"], kept, bits))
        rounds += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """Which rows stay when of equal texts the one with the largest id stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256.
    Null and empty texts are one group. A null id ranks below all others; of equal
    ids exactly one row stays. An empty table gives an empty result. Other columns
    are not read, so their names cannot clash.
    """
    named = store(document_identities(documents, id_col, text_col, block_bytes, bits))
    groups = store(named.groupBy("rounds", "name").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    ))
    return named.join(groups, ["rounds", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, whose text no row with a larger id repeats; repeated rows stay once.

    The decision is joined back by id and digest, so rows with one id and different texts keep their own decision.
    """
    # columns get numbers for names, so that none of the input's clashes with those used here
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    id_name = names[id_col]
    digest = F.sha2(F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")).cast("binary"), 256)
    decided = store(exact_dedup(rows, id_name, names[text_col]).select(
        F.col(id_name).alias("_keep_id"), F.col("text_sha256").alias("_keep_digest"), F.col("kept").alias("_kept")
    ))
    stay = decided.where("_kept").drop("_kept")
    out = rows.withColumn("_digest", digest).join(
        stay, F.col(id_name).eqNullSafe(F.col("_keep_id")) & (F.col("_digest") == F.col("_keep_digest")), "left_semi")
    repeated = decided.groupBy("_keep_id", "_keep_digest").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([id_name, "_digest"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
