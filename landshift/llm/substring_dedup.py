"""Removal of word windows that a document with a smaller id already has, by suffix automata of reference shards.

Windows of 13 words that repeat share an anchor (see `anchors`). Members of a bucket of
equal anchors are settled at once where all the words around the anchor recur in an
earlier document. What is left, the borders of shared passages, goes to shards by its
anchor: each shard compiles its word sequences, earliest document first, into a
suffix automaton and streams them through it; matching statistics tell for each window
the earliest document that holds it. Anchors with very many different surroundings would
make one shard too large; their windows are counted one by one instead, by aggregation.

A shard's automaton is built where its members meet, not sent to every document: all
documents are references here, and sending all shards to all of them would be quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from landshift.llm.anchors import window_anchors
from landshift.llm.automaton import SuffixAutomaton
from landshift.llm.storage import store, store_by_key

WINDOW = 13
GRAM = 4
SAMPLE = 2000  # documents looked at to find anchors with very many surroundings; they take another way, with equal results
POPULAR = 0.02  # share of the sample with different surroundings that makes an anchor one of them
LARGE = 4096  # members of a bucket from which it takes that way too
FLUSH = 1_000_000  # anchors held before they are dealt out
SHARD_WORDS = 200_000  # words compiled into one automaton
CACHED_WORDS = 400_000
CHUNK = 512

SETTLED, OPEN, CROWDED = 0, 1, 2
_R = 0x9E3779B97F4A7C15
_INVERSE = pow(_R, -1, 1 << 64)
COLUMNS = [("inner", "<u8"), ("outer", "<u8"), ("order", "<i8"), ("row", "<i8"), ("at", "<i4"), ("back", "u1"), ("ahead", "u1"), ("kind", "u1")]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_R, _INVERSE)):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    out = words[:n].copy()
    for k in range(1, gram):
        out = out * np.uint64(_R) + words[k:n + k]
    return out ^ (out >> np.uint64(29))


def document_anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(inner, outer, at, back, ahead): name of the gram at each anchor, name of all words its windows cover, offsets of its first and last window."""
    grams = gram_hashes(words, gram)
    at, first, last = window_anchors(grams, window - gram + 1)
    up, down = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
    outer = (sums[last + window] - sums[first]) * down[first]
    outer = outer ^ (((at - first) * 256 + (at - last)).astype(np.uint64) * np.uint64(_R))
    return grams[at], outer, at, at - first, at - last


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns byte plane by byte plane, which compresses well where numbers are small or near."""
    return b"".join(np.ascontiguousarray(columns[c].astype(t)).view(np.uint8).reshape(len(columns[c]), -1).T.tobytes() for c, t in COLUMNS)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    sizes = [np.dtype(t).itemsize for _, t in COLUMNS]
    n, at, out = len(data) // sum(sizes), 0, {}
    for (c, t), size in zip(COLUMNS, sizes):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out[c] = np.ascontiguousarray(planes.T).view(t).reshape(n)
        at += n * size
    return out


def _classes(inner: np.ndarray, outer: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting by bucket, class and order; number of each one's bucket and class."""
    sort = np.lexsort((order, outer, inner))
    i, o = inner[sort], outer[sort]
    new_bucket = np.concatenate([np.ones(min(1, len(i)), bool), i[1:] != i[:-1]])
    new_class = new_bucket | np.concatenate([np.ones(min(1, len(i)), bool), o[1:] != o[:-1]])
    return sort, np.cumsum(new_bucket) - 1, np.cumsum(new_class) - 1


def _dealt(held: list[dict], buckets: int, popular: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket. Those that an earlier document of this task settles, and popular ones, only pass through."""
    all_ = {c: np.concatenate([h[c] for h in held]) for c, _ in COLUMNS}
    sort, _, number = _classes(all_["inner"], all_["outer"], all_["order"])
    all_ = {c: v[sort] for c, v in all_.items()}
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    all_["kind"] = np.where(all_["order"] > all_["order"][starts][number], SETTLED, np.where(np.isin(all_["inner"], popular), CROWDED, OPEN)).astype(np.uint8)
    through = all_["kind"] != OPEN
    bucket = np.where(through, buckets + all_["row"] % buckets, (all_["inner"] % np.uint64(buckets)).astype(np.int64))
    sort = np.argsort(bucket, kind="stable")
    all_, bucket = {c: v[sort] for c, v in all_.items()}, bucket[sort]
    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
    rows = [(int(bucket[a]), pack({c: v[a:b] for c, v in all_.items()})) for a, b in zip(cuts, cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int, popular: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for batch in batches:
        for row, order, text in zip(batch.column("row").to_pylist(), batch.column("order").to_pylist(), batch.column("data")):
            words = text.as_py().split()
            if len(words) < window:
                continue
            inner, outer, at, back, ahead = document_anchors(word_hashes(words), window, gram)
            n = len(at)
            held.append({"inner": inner, "outer": outer, "order": np.full(n, order), "row": np.full(n, row), "at": at, "back": back, "ahead": ahead, "kind": np.zeros(n)})
            size += n
            if size > FLUSH:
                yield from _dealt(held, buckets, popular)
                held, size = [], 0
    if held:
        yield from _dealt(held, buckets, popular)


def _surroundings(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("data"):
            words = text.as_py().split()
            if len(words) >= window:
                inner, outer, *_ = document_anchors(word_hashes(words), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64))], ["inner", "outer"])


def popular_anchors(texts: DataFrame, window: int, gram: int) -> np.ndarray:
    """Anchors with many surroundings in a sample of about SAMPLE rows, drawn by hash, each in the task that has it."""
    rate = min(1.0, SAMPLE / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < int(rate * (1 << 20))).select("data")
    sample = drawn.mapInArrow(lambda it: _surroundings(it, window, gram), "inner bigint, outer bigint")
    many = sample.distinct().groupBy("inner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= POPULAR * SAMPLE).collect()
    return np.array([r.inner for r in many], dtype=np.int64).view(np.uint64)


def _bucket(table: pa.Table) -> pa.Table:
    """Rows of one bucket: settled where an earlier document has all words around the anchor, open where one may have some."""
    held = [unpack(p.as_py()) for p in table.column("packed")]
    all_ = {c: np.concatenate([h[c] for h in held]) for c, _ in COLUMNS}
    if (all_["kind"] == OPEN).all():
        sort, bucket, number = _classes(all_["inner"], all_["outer"], all_["order"])
        all_ = {c: v[sort] for c, v in all_.items()}
        order = all_["order"]
        least = order[np.flatnonzero(np.diff(number, prepend=-1))][number]
        settled = order > least
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        low, high = np.minimum.reduceat(order, starts)[bucket], np.maximum.reduceat(order, starts)[bucket]
        several = np.maximum.reduceat(number, starts)[bucket] > np.minimum.reduceat(number, starts)[bucket]
        open_ = ~settled & several & (low < high)
        sizes = np.add.reduceat(open_.astype(np.int64), starts)[bucket]
        kind = np.where(settled, SETTLED, np.where(sizes > LARGE, CROWDED, OPEN))
        keep = settled | open_
        all_ = {c: v[keep] for c, v in (all_ | {"kind": kind}).items()}
    first, last = all_["at"] - all_["back"], all_["at"] - all_["ahead"]
    return pa.table({
        "row": pa.array(all_["row"]), "kind": pa.array(all_["kind"].astype(np.int8)), "at": pa.array(all_["at"].astype(np.int32)),
        "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32)),
    })


def _contexts(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The words that the windows of an open anchor cover, as hashes, with the gram that names the shard."""
    for batch in batches:
        rows: list[tuple] = []
        for row, order, text, todo in zip(*(batch.column(c).to_pylist() for c in ("row", "order", "data", "todo"))):
            words = word_hashes(text.split())
            grams = gram_hashes(words, gram).view(np.int64)
            rows += [(row, order, t["kind"] == CROWDED, int(grams[t["at"]]), t["first"], words[t["first"]:t["last"] + window].tobytes()) for t in todo]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["row", "order", "crowded", "inner", "first", "words"])


def _windows(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([r[i] for r in rows] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(b, pa.int32())], ["row", "first", "last"])


def _shard(members: list[tuple], window: int) -> pa.RecordBatch:
    """Windows of the members that an earlier member holds."""
    members.sort(key=lambda m: m[0])
    automaton = SuffixAutomaton()
    for order, _, _, words in members:
        automaton.add(words, order)
    return _windows([(row, first + i) for order, row, first, words in members
                     for i, earliest in enumerate(automaton.first_orders(words, window)) if earliest < order])


def _stream(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Shards of whole buckets, which arrive sorted by anchor."""
    members, size, now = [], 0, None
    for batch in batches:
        for inner, order, row, first, words in zip(*(batch.column(c).to_pylist() for c in ("inner", "order", "row", "first", "words"))):
            if inner != now and size > SHARD_WORDS:
                yield _shard(members, window)
                members, size = [], 0
            now = inner
            members.append((order, row, first, memoryview(words).cast("Q").tolist()))
            size += len(words) // 8
    if members:
        yield _shard(members, window)


def _each_window(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for order, row, first, words in zip(*(batch.column(c).to_pylist() for c in ("order", "row", "first", "words"))):
            for i in range(len(words) // 8 - window + 1):
                name = xxhash.xxh3_128_digest(words[8 * i:8 * (i + window)])
                rows.append((name, order, row, first + i))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["name", "order", "row", "first"])


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for cut in range(0, batch.num_rows, CHUNK):
            part = batch.slice(cut, CHUNK)
            counts, spans, kept = [], [], []
            for text, found in zip(part.column("data").to_pylist(), part.column("found").to_pylist()):
                words, runs = text.split(), []
                for start, end in sorted((f["first"], f["last"] + window) for f in found or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *(x for run in runs for x in run), len(words)]
                counts.append(len(words))
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]))
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             ["id", "n_words", "spans", "kept"])


def remove_seen_windows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, spans, kept) per row: removed runs of words, and the words left, joined by spaces.

    A word goes if a window of `window` words that covers it also starts in a row with a
    smaller id. Null texts have no words; rows with a null id come after all others; rows
    that share an id remove nothing from each other; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    last = F.lit((1 << 63) - 1)
    texts = store_by_key(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), last).alias("order"), text.cast("binary").alias("data")), "row")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    popular = popular_anchors(texts, window, gram)
    dealt = texts.mapInArrow(lambda it: _anchors(it, window, gram, buckets, popular), "bucket int, packed binary")
    members = store(dealt.groupBy("bucket").applyInArrow(_bucket, "row bigint, kind tinyint, at int, first int, last int"))

    todo = members.where(F.col("kind") != SETTLED).groupBy("row").agg(F.collect_list(F.struct("kind", "at", "first", "last")).alias("todo"))
    contexts = store(texts.join(todo, "row").mapInArrow(
        lambda it: _contexts(it, window, gram), "row bigint, order bigint, crowded boolean, inner bigint, first int, words binary"))
    few = contexts.where("NOT crowded").select("inner", "order", "row", "first", "words")
    streamed = few.repartition("inner").sortWithinPartitions("inner").mapInArrow(lambda it: _stream(it, window), "row bigint, first int, last int")
    single = store(contexts.where("crowded").mapInArrow(lambda it: _each_window(it, window), "name binary, order bigint, row bigint, first int"))
    earliest = store(single.groupBy("name").agg(F.min("order").alias("least"), F.max("order").alias("most")).where("least < most").drop("most"))
    counted = single.join(earliest, "name").where("order > least").select("row", "first", F.col("first").alias("last"))

    spans = store(members.where(F.col("kind") == SETTLED).select("row", "first", "last").unionByName(streamed).unionByName(counted))
    found = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    out = texts.join(found, "row", "left").select("id", "data", "found")
    done = out.mapInArrow(lambda it: _removed(it, window), "id bigint, n_words bigint, spans array<struct<start:int,end:int>>, kept binary")
    return done.withColumnRenamed("id", id_col)
