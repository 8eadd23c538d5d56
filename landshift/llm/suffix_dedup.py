"""Removal of long repeated byte strings by bucket-pointer refinement.

Strings of 400 bytes that repeat share an anchor (see `anchors`), a 58-gram chosen by
content, so only anchors are put into initial q-gram buckets. A bucket holds the
strings around its anchors at up to 343 offsets. Buckets are refined by the identifiers
of what lies at further offsets: a range of offsets is named by the bytes that all its
strings share (inner) and by all bytes they cover (outer). Members with equal outer names
repeat whole; members alone in their inner bucket do not repeat; the others go on with
a seventh of the range, until a single offset is left. One member stands for all that
were settled together, so popular passages do not grow the later rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.anchors import window_anchors
from landshift.llm.storage import discard, store, store_by_key

ARITY = 7
ROUNDS = 3
OFFSETS = ARITY**ROUNDS
LENGTH = 400
CHUNK = 512

MEMBER = "row bigint, at int, run_lo int, run_hi int, core bigint, node int, active boolean, inner bigint, outer bigint"
NAMES = [f.split()[0] for f in MEMBER.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _name(data: bytes, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data, seed))


def _outer(text: bytes, at: int, lo: int, hi: int, length: int) -> int:
    """Name of all bytes that the strings at offsets lo to hi cover, and of those offsets."""
    return _name(text[at - hi:at - lo + length], (lo << 32 | hi) + 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS)], NAMES)


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    gram = length - OFFSETS + 1
    for batch in batches:
        rows: list[tuple] = []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("data")):
            data = text.as_py()
            if len(data) < length:
                continue
            order = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))[:len(data) - gram + 1]
            for at, first, last in zip(*(a.tolist() for a in window_anchors(order, OFFSETS))):
                inner = _name(data[at:at + gram])
                rows.append((row, at, at - last, at - first, inner, 0, True, inner, _outer(data, at, at - last, at - first, length)))
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _children(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Members of the next round: for each range of offsets to refine, its parts of `width` offsets that the anchor serves."""
    for batch in batches:
        rows: list[tuple] = []
        for row, text, todo in zip(batch.column("row").to_pylist(), batch.column("data"), batch.column("todo").to_pylist()):
            data = text.as_py()
            for t in todo:
                at = t["at"]
                for node in range(t["node"], t["node"] + ARITY * width, width):
                    lo, hi = max(node, t["run_lo"]), min(node + width - 1, t["run_hi"])
                    if lo <= hi:
                        inner = _name(data[at - node:at - node - width + 1 + length])
                        rows.append((row, at, t["run_lo"], t["run_hi"], t["core"], node, t["active"], inner, _outer(data, at, lo, hi, length)))
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _settle(members: DataFrame, bucket: list[str], width: int) -> tuple[DataFrame, DataFrame | None]:
    """(repeats, rest): strings that repeat, as (row, start, end) of their first bytes; and members to refine.

    Buckets and classes are counted by aggregation; what joins back to the members is
    a written table on either side, so that a popular bucket can be split.
    """
    buckets = store(
        members.groupBy(*bucket).agg(
            F.count(F.lit(1)).alias("n"), F.max("active").alias("some"), F.min("outer").alias("low"), F.max("outer").alias("high")
        ).where("n > 1 AND some").select(*bucket, (F.col("low") == F.col("high")).alias("whole"))
    )
    lo, hi = F.greatest("node", "run_lo"), F.least(F.col("node") + width - 1, F.col("run_hi"))
    span = ["row", (F.col("at") - hi).alias("start"), (F.col("at") - lo).alias("end")]
    met = members.join(buckets, bucket)
    if width == 1:
        return met.where("active").select(*span), None
    met = store(met)
    mixed = met.where("NOT whole").drop("whole")
    classes = store(mixed.groupBy(*bucket, "outer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("first")
    ).where("n > 1"))
    marked = mixed.join(classes, [*bucket, "outer"], "left")
    repeats = met.where("whole AND active").select(*span).unionByName(marked.where("n IS NOT NULL AND active").select(*span))
    one = F.struct("row", "at") == F.col("first")
    rest = marked.where(F.col("n").isNull() | one).select(*[c for c in NAMES if c != "active"], (F.col("active") & F.col("n").isNull()).alias("active"))
    return repeats, rest


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for cut in range(0, batch.num_rows, CHUNK):
            part = batch.slice(cut, CHUNK)
            kept, spans = [], []
            for text, found in zip(part.column("data"), part.column("found").to_pylist()):
                data, runs = text.as_py(), []
                for start, end in sorted((f["start"], f["end"] + length) for f in found or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t.as_py()) for t in part.column("data")], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"])


def _with_lists(texts: DataFrame, rows: DataFrame, name: str, columns: list[str | Column], how: str) -> DataFrame:
    """Texts with the rows that belong to them in one list, which their own length bounds."""
    return texts.join(rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias(name)), "row", how)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) per row: removed runs of bytes and the bytes left.

    A byte goes if a `length`-byte string that covers it also starts elsewhere, in any
    row. Null counts as empty; rows shorter than `length` stay whole; repeated rows repeat
    each other; rows with a null id take part; an empty table gives an empty result.
    """
    if length < OFFSETS + 8:
        raise ValueError(f"length must be at least {OFFSETS + 8}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # bucketed by a number of its own for each row, so that copies are spread and later joins leave the texts where they are
    texts = store_by_key(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), text.cast("binary").alias("data")), "row")
    members = store(texts.mapInArrow(lambda it: _anchors(it, length), MEMBER))
    repeats, rest = _settle(members, ["inner"], OFFSETS)
    found = [store(repeats)]
    width = OFFSETS
    while rest is not None:
        width //= ARITY
        todo = _with_lists(texts, rest, "todo", ["at", "run_lo", "run_hi", "core", "node", "active"], "inner")
        next_members = store(todo.mapInArrow(lambda it, w=width: _children(it, length, w), MEMBER))
        discard(members)
        members = next_members
        repeats, rest = _settle(members, ["core", "node", "inner"], width)
        found.append(store(repeats))
    spans = found[0]
    for part in found[1:]:
        spans = spans.unionByName(part)
    done = _with_lists(texts, spans, "found", ["start", "end"], "left")
    out = done.mapInArrow(lambda it: _spans(it, length), "id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumnRenamed("id", id_col)
