"""Exact inner-product search with multi-resolution segment statistics.

A vector is cut into equal segments. With mean m and deviation s of each segment of
length n, the squared distance of two vectors is at least the sum of n((m-m')^2 + (s-s')^2),
which bounds their inner product from above by the sum of n(mm' + ss'). Bounds go from a
few long segments to many short ones; a candidate whose bound falls below the k-th best
score known for a query is dropped, and exact scores are computed for the rest.

Queries travel in rounds of bounded size; every round streams all candidates past them
in blocks, so neither side has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.llm.storage import discard, store

SCALE = 1024
LEVELS = (4, 8, 16)  # segments, coarse to fine
ROUND_COMPONENTS = 1 << 20  # components of the queries broadcast at once: some 25 MB with their statistics
BLOCK = 1024  # candidates compared at once
QUERY_BLOCK = 128
PRODUCTS = 1 << 21  # components multiplied at once


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>) of rows whose vector is not null and holds finite components only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of each dimension that occurs in a column of integer lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        values = flat[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d) if d else np.zeros((len(rows), 0), np.int64)
        out.append((rows, values))
    return out


class Block:
    """Integer vectors of one dimension with their ids and the statistics of each level."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.exact = values.astype(float)
        self.largest = float(np.abs(self.exact).max(initial=0))
        self.stats = [self._statistics(n) for n in LEVELS]

    def _statistics(self, segments: int) -> np.ndarray:
        """Means and deviations of the segments, each times the root of its length, side by side."""
        parts = np.array_split(self.exact, min(segments, max(1, self.exact.shape[1])), axis=1)
        root = [np.sqrt(p.shape[1]) for p in parts]
        return np.column_stack([p.mean(axis=1) * r if p.shape[1] else p.sum(axis=1) for p, r in zip(parts, root)]
                               + [p.std(axis=1) * r if p.shape[1] else p.sum(axis=1) for p, r in zip(parts, root)])

    def part(self, rows: np.ndarray | slice) -> "Block":
        out = object.__new__(Block)
        out.ids, out.values, out.exact, out.largest = self.ids[rows], self.values[rows], self.exact[rows], self.largest
        out.stats = [s[rows] for s in self.stats]
        return out


def scores(queries: np.ndarray, candidates: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact inner products of chosen pairs, in Python integers where 64 bits could overflow."""
    width = max(1, queries.shape[1])
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0)) * width
    if bound < 2**62:
        return products(queries, candidates, pairs)
    return np.array([sum(int(x) * int(y) for x, y in zip(queries[i], candidates[j])) for i, j in zip(*pairs)], dtype=object)


def products(queries: np.ndarray, candidates: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row-wise products of chosen pairs, a bounded number at a time."""
    step = max(1, PRODUCTS // max(1, queries.shape[1]))
    cuts = range(0, max(1, len(pairs[0])), step)
    return np.concatenate([np.einsum("ij,ij->i", queries[pairs[0][i:i + step]], candidates[pairs[1][i:i + step]]) for i in cuts])


class Best:
    """The k best candidates of each query so far, ties to the smaller id."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray) -> None:
        self.queries, self.k, self.floor = queries, k, floor.copy()
        self.found: list[list[tuple]] = [[] for _ in queries.ids]

    def add(self, candidates: Block) -> None:
        for at in range(0, len(self.queries.ids), QUERY_BLOCK):
            self._add(at, self.queries.part(slice(at, at + QUERY_BLOCK)), candidates)

    def _add(self, at: int, queries: Block, candidates: Block) -> None:
        floor = self.floor[at:at + len(queries.ids)]
        # rounding of the bound: far above the error of summing this many products of doubles
        slack = 1 + 1e-9 * queries.largest * max(1.0, candidates.largest) * max(1, queries.exact.shape[1])
        rows, columns = np.nonzero(queries.stats[0] @ candidates.stats[0].T + slack >= floor[:, None])
        for q, c in zip(queries.stats[1:], candidates.stats[1:]):
            near = products(q, c, (rows, columns)) + slack >= floor[rows]
            rows, columns = rows[near], columns[near]
        other = queries.ids[rows] != candidates.ids[columns]
        rows, columns = rows[other], columns[other]
        exact = scores(queries.values, candidates.values, (rows, columns))
        good = exact >= floor[rows]
        rows, columns, exact = rows[good], columns[good], exact[good]
        cuts = np.searchsorted(rows, np.arange(len(queries.ids) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[i], cuts[i + 1])
            new = sorted([*self.found[at + i], *zip((-exact[part]).tolist(), candidates.ids[columns[part]].tolist())])[:self.k]
            self.found[at + i] = new
            if len(new) == self.k:
                self.floor[at + i] = max(self.floor[at + i], -new[-1][0])


def _search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    best = {d: Best(queries, k, floor) for d, (queries, floor) in shared.value.items()}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        for rows, values in matrix(batch.column("v")):
            if (search := best.get(values.shape[1])) is not None:
                for at in range(0, len(rows), BLOCK):
                    search.add(Block(ids[rows[at:at + BLOCK]], values[at:at + BLOCK]))
    for search in best.values():
        out = [(int(q), c, -s) for q, found in zip(search.queries.ids, search.found) for s, c in found]
        if out:
            q, c, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])


def _floors(queries: Block, k: int) -> np.ndarray:
    """A score that the k-th best candidate of each query reaches: its k-th best among the other queries."""
    best = Best(queries, k, np.full(len(queries.ids), -np.inf))
    for at in range(0, min(len(queries.ids), 4 * BLOCK), QUERY_BLOCK):
        best.add(queries.part(slice(at, at + QUERY_BLOCK)))
    return best.floor


def top_k(candidates: DataFrame, is_query: Column, k: int = 10, round_components: int = ROUND_COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller vec_id.

    `candidates` has (vec_id, v) as `quantised` returns it. A candidate with the
    query's own id does not count, so repeated rows of a query are left out too;
    repeated rows of other ids fill several ranks. Vectors of another length than the
    query's take no part. A query without candidates has no row.
    """
    spark = candidates.sparkSession
    stored = store(candidates)
    queries = store(stored.where(is_query).dropDuplicates(["vec_id", "v"]))
    components = queries.agg(F.sum(F.size("v"))).first()[0] or 0
    rounds = max(1, -(-2 * components // round_components))
    parts = []
    for r in range(rounds):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").toArrow()
        blocks = {}
        for rows, values in matrix(mine.column("v").combine_chunks()) if mine.num_rows else []:
            block = Block(mine.column("vec_id").to_numpy()[rows], values)
            blocks[values.shape[1]] = (block, _floors(block, k))
        shared = spark.sparkContext.broadcast(blocks)
        found = stored.mapInArrow(lambda it, s=shared: _search(it, s, k), "query_id bigint, vec_id bigint, score bigint")
        parts.append(store(found))
        shared.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    discard(stored, queries)
    return ranked
