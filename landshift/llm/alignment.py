"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes, so their tokens form groups between the places where both
end a token. Every token points to the token of the other side that reaches farthest right
among those it overlaps, or to itself where none reaches farther; doubling the successors of
all tokens at once, until nothing moves, leads each to the last token of its group, which
names the group.

A single space or line feed between two characters that are no white space is such a place, whatever
stands around it: no piece of either vocabulary reaches over its front. A text is therefore aligned
unit by unit, and a unit (a word with the space or line feed before it) is tokenized once per worker as long
as it is remembered, not once per occurrence. One pass counts how often two ids are linked in
all texts; a second one aligns again, which costs less than writing all links, and adds the
counts up. The most frequent pairs are broadcast, up to a fixed number, and links of the others
meet their count in a join.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landshift.llm.bpe import byte_symbols
from landshift.llm.storage import discard, store

HEAD_PAIRS = 1_000_000  # pairs of ids whose counts are broadcast, 16 bytes each
CACHED_UNITS = 250_000  # units a worker remembers before it starts afresh
CACHED_BYTES = 64_000_000  # of these units' texts
CHUNK_CHARS = 2_000_000  # of texts handled at once
CHUNK_ROWS = 512
TOGETHER = 500  # units encoded as one text

_SIGNS = np.array([",", "|", ";"], dtype=object)

_UNIT = re.compile(r"[ \n]\S+")
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def units(text: str) -> list[str]:
    """A space and the text, in parts that both tokenizers cut at."""
    line = " " + text
    found = _UNIT.findall(line)
    return found if sum(map(len, found)) == len(line) else _BORDER.split(line)


class Tokenizers:
    """Token ids of units by the byte-level vocabulary A and the prefix-space vocabulary B, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        value = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            self.a_bytes[i] = bytes(map(value.__getitem__, piece))
        # the library below merges by id, which is the rank as long as merges were numbered in their order
        made = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(made) or (made and min(made) <= max(ids[s] for s in byte_symbols())):
            raise ValueError("the merges of vocabulary A are not in the order of their ids")
        ranks = {data: i for i, data in enumerate(self.a_bytes) if data}
        self._a = tiktoken.Encoding(uuid.uuid4().hex, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.front = self._b.piece_to_id("▁")  # what B puts before a text that starts with white space
        # a space starts a piece of B, and a line feed is a byte of its own
        if any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in map(self._b.id_to_piece, range(len(self.b_bytes)))):
            raise ValueError("vocabulary B has pieces that reach over a space or a line feed")
        self.a_length = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.a_names, self.b_names = (np.array(list(map(str, range(len(x)))), dtype=object) for x in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(units, their byte lengths, ids of A, ids of B, refused): units whose bytes both sides give back, in one sequence of ids.

        Many units are encoded as one text, which both sides cut at their borders. Units that
        a border need not follow or that may be changed, and texts that were, go one by one.
        """
        plain = [u for u in some if _UNIT.fullmatch(u) and "▁" not in u]
        known = set(plain)
        good, a, b, refused = [], [], [], []
        for i in range(0, len(plain), TOGETHER):
            part = plain[i:i + TOGETHER]
            if (found := self._encode("".join(part))) is not None:
                good += part
                a.append(found[0])
                b.append(found[1])
            else:
                known.difference_update(part)
        for unit in some:
            if unit not in known:
                if (found := self._encode(unit)) is None:
                    refused.append(unit)
                else:
                    good.append(unit)
                    a.append(found[0])
                    b.append(found[1])
        none = np.empty(0, dtype=np.int64)
        return good, np.fromiter((len(u.encode()) for u in good), np.int64, len(good)), np.concatenate([none, *a]), np.concatenate([none, *b]), refused

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, None unless both give back the bytes of the text."""
        a = self._a.encode_ordinary(text)
        b = self._b.encode(text[text[0] == " ":])
        if text[0] != " " and b[:1] == [self.front]:
            del b[0]
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, given the ends of both, the token of A that ends its group."""
    n = len(a_end)
    reach = np.searchsorted(b_end, a_end)  # the token of B that holds the last byte
    farther = b_end[reach] > a_end
    point = np.concatenate([np.where(farther, n + reach, np.arange(n)), np.searchsorted(a_end, b_end)])
    while True:
        jumped = point[point]
        if (jumped == point).all():
            return point[:n], point[n:]
        point = jumped


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, a, b) of every pair of tokens that share bytes; the shared bytes of a pair are one stretch."""
    ends = np.union1d(a_end, b_end)
    return ends, np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


class Units:
    """Aligned units of a worker; `add` gives each a number, by which the columns are read."""

    COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "ok", "n_best", "count_sum", "n_tail")

    def __init__(self, tokenizers: Tokenizers, counts: PairCounts | None) -> None:
        self.tokenizers, self.counts = tokenizers, counts
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.size = 0
        self._parts: list[dict[str, np.ndarray]] = []
        self._keys: list[np.ndarray] = []
        self._tails: list[np.ndarray] = []

    def full(self) -> bool:
        return len(self.number) > CACHED_UNITS or self.size > CACHED_BYTES

    def column(self, name: str) -> np.ndarray:
        if len(self._parts) > 1:
            self._parts = [{c: np.concatenate([p[c] for p in self._parts]) for c in self.COLUMNS}]
        return self._parts[0][name] if self._parts else np.empty(0, dtype=np.int64)

    def keys(self, tail: bool = False) -> np.ndarray:
        """Pairs of ids of all links in the order of the units; with `tail`, those whose count is not at hand."""
        held = self._tails if tail else self._keys
        if len(held) > 1:
            held[:] = [np.concatenate(held)]
        return held[0] if held else np.empty(0, dtype=np.int64)

    def add(self, some: list[str]) -> None:
        """Align units that are not yet known."""
        if not some:
            return
        good, size, a_ids, b_ids, refused = self.tokenizers(some)
        for unit in chain(good, refused):
            self.number[unit] = len(self.number)
        self.size += sum(map(len, some))
        zero, n = np.zeros(len(some), dtype=np.int64), len(good)
        part = {c: zero.copy() for c in self.COLUMNS}
        part["ok"][:n] = 1
        keys = tails = np.empty(0, dtype=np.int64)
        strings: list[str] = []
        if n:
            a_end, b_end, unit_end = np.cumsum(self.tokenizers.a_length[a_ids]), np.cumsum(self.tokenizers.b_length[b_ids]), np.cumsum(size)
            a_last, b_last = group_ends(a_end, b_end)
            ends, at_a, at_b = links(a_end, b_end)
            last = np.unique(a_last)
            for name, of in (("n_a", a_end), ("n_b", b_end), ("n_groups", a_end[last]), ("n_links", ends)):
                part[name][:n] = np.diff(np.searchsorted(of, unit_end, "right"), prepend=0)
            keys = a_ids[at_a] << 32 | b_ids[at_b]
            if self.counts is None:
                strings = [""] * n
            else:
                strings = self._strings(a_ids, b_ids, a_last, b_last, part["n_a"][:n] + part["n_b"][:n])
                owner = np.repeat(np.arange(n), part["n_links"][:n])
                count, best = self.counts.of(keys)
                known = count > 0
                part["count_sum"][:n] = np.bincount(owner, count, n)
                part["n_best"][:n] = np.bincount(owner[best], minlength=n)
                part["n_tail"][:n] = np.bincount(owner[~known], minlength=n)
                tails = keys[~known]
        self._parts.append(part)
        self._keys.append(keys)
        self._tails.append(tails)
        self.groups += strings + [""] * len(refused)

    def _strings(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The groups of each unit, given how many tokens it has: the tokens of a group come together, those of A first."""
        place = np.concatenate([a_last * 2, b_last * 2 + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        names = np.concatenate([self.tokenizers.a_names[a_ids], self.tokenizers.b_names[b_ids]])[order]
        after = np.append(place[1:], -1)
        sign = _SIGNS[np.where(after == place, 0, np.where(after // 2 == place // 2, 1, 2))]
        ends = np.cumsum(sizes)
        sign[ends - 1] = ""
        pieces = np.empty(2 * len(names), dtype=object)
        pieces[::2], pieces[1::2] = names, sign
        parts = pieces.tolist()
        out, start = [], 0
        for end in (2 * ends).tolist():
            out.append("".join(parts[start:end]))
            start = end
        return out


class PairCounts:
    """Counts of the most frequent pairs of ids, sorted by pair, and the highest count of each id of B."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        self.keys, self.counts, self.highest = keys, counts, best

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, zero where it is not at hand, and whether it is the highest of its id of B."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        count = np.where(self.keys[at] == keys, self.counts[at], 0)
        return count, (count > 0) & (count == self.highest[keys & 0xFFFFFFFF])


_HELD: dict[str, Units] = {}  # of this worker; one at a time


def _held(shared) -> Units:
    name, a_path, b_path, counts = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Units(Tokenizers(a_path, b_path), counts)
    return _HELD[name]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Parts of bounded size, and the units of each of their texts (none for null and empty ones)."""
    for batch in batches:
        sizes = [len(t.as_py() or "") for t in batch.column("text")]
        start = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held > CHUNK_CHARS or i - start + 1 >= CHUNK_ROWS or i == len(sizes) - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, [units(t) if t else [] for t in part.column("text").to_pylist()]
                start, held = i + 1, 0


def _numbered(known: Units, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all units of the texts, one text after another, and how many each text has."""
    known.add(list(set().union(*texts).difference(known.number)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    number = known.number.__getitem__
    return np.fromiter(chain.from_iterable(map(number, t) for t in texts), np.int64, sizes.sum()), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _folded(known: Units, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the links of all units, each unit counted as often as its weight says."""
    n_links = known.column("n_links")
    weight = np.repeat(weights[:len(n_links)], n_links)
    keys = known.keys()[weight > 0]
    pairs, place = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(counts, place, weight[weight > 0])
    for i in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i:i + 100_000]), pa.array(counts[i:i + 100_000])], ["pair", "n"])


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known = _held(shared)
    weights = np.zeros(len(known.number), dtype=np.int64)
    for _, texts in _chunks(batches):
        if known.full():
            yield from _folded(known, weights)
            known.clear()
            weights = np.zeros(0, dtype=np.int64)
        numbers, sizes = _numbered(known, texts)
        if not len(numbers):
            continue
        whole = _sums(known.column("ok")[numbers], sizes) == sizes
        found = np.bincount(numbers[np.repeat(whole, sizes)], minlength=len(known.number))
        found[:len(weights)] += weights
        weights = found
    if len(weights):
        yield from _folded(known, weights)


def _align(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known = _held(shared)
    tail_type = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
    for part, texts in _chunks(batches):
        if known.full():
            known.clear()
        numbers, sizes = _numbered(known, texts)
        whole = (_sums(known.column("ok")[numbers], sizes) == sizes) & (sizes > 0)
        columns = [np.where(whole, _sums(known.column(c)[numbers], sizes), 0) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        ends, held, strings = np.cumsum(sizes).tolist(), numbers.tolist(), known.groups.__getitem__
        groups = [";".join(map(strings, held[end - n:end])) if ok else "" for ok, n, end in zip(whole.tolist(), sizes.tolist(), ends)]
        tails: list[list[dict[str, int]]] = [[] for _ in texts]
        n_tail = known.column("n_tail")
        if len(n_tail) and n_tail[numbers].any():
            first = np.cumsum(n_tail) - n_tail
            for t in np.flatnonzero(whole & (_sums(n_tail[numbers], sizes) > 0)):
                end = int(sizes[:t + 1].sum())
                mine = numbers[end - sizes[t]:end]
                found = np.concatenate([known.keys(tail=True)[first[i]:first[i] + n_tail[i]] for i in mine if n_tail[i]])
                pairs, n = np.unique(found, return_counts=True)
                tails[t] = [{"pair": p, "n": m} for p, m in zip(pairs.tolist(), n.tolist())]
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:-1], *[pa.array(c.astype(np.int64)) for c in columns], pa.array(groups, pa.string()), pa.array(tails, tail_type)],
            [*part.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "tail"])


def _frequent(pairs: DataFrame, b_size: int, most: int) -> tuple[PairCounts, bool]:
    """Counts of the most frequent pairs, by whole steps of a sixteenth of a power of two, and whether these are all."""
    steps = {r.step: r["count"] for r in pairs.groupBy("step").count().collect()}
    held, least = 0, None
    for step in sorted(steps, reverse=True):
        if held + steps[step] > most:
            break
        held, least = held + steps[step], step
    head = pairs.where(F.col("step") >= least if least is not None else F.lit(False)).select("pair", "n").toArrow()
    keys, counts = (head.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    best = np.zeros(b_size, dtype=np.int64)
    for r in pairs.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r.b] = r.n
    return PairCounts(keys[order], counts[order], best), held == sum(steps.values())


def align_tokenizers(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                     head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row.

    A encodes a space and the text, B the text. `groups` lists the ids of each group as
    `a1,a2|b1`, groups apart by semicolons. A link is a pair of tokens that share bytes; its
    count is how often its two ids are linked in all documents; n_best counts the links whose
    count is the highest of their id of B. Null and empty texts, and texts of which one side does
    not give back the bytes, have zeros and no groups, and add to no count. Repeated rows count
    each; null ids are kept; other columns are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    first = spark.sparkContext.broadcast((uuid.uuid4().hex, a_path, b_path, None))
    found = documents.select(text).where("text IS NOT NULL AND text != ''").mapInArrow(lambda it: _count(it, first), "pair bigint, n bigint")
    pairs = store(found.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    tokenizers = Tokenizers(a_path, b_path)
    counts, all_held = _frequent(pairs, len(tokenizers.b_bytes), head_pairs)
    second = spark.sparkContext.broadcast((uuid.uuid4().hex, a_path, b_path, counts))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"row bigint, id {kind}, {', '.join(f'{n} bigint' for n in names)}, groups string, tail array<struct<pair:bigint,n:bigint>>"
    out = rows.mapInArrow(lambda it: _align(it, second), schema)
    if all_held:
        discard(pairs)
    else:
        out = store(out)
        highest = pairs.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("n").alias("highest"))
        rest = out.select("row", F.explode("tail").alias("t")).select("row", F.col("t.pair").alias("pair"), F.col("t.n").alias("times"))
        met = rest.join(pairs.select("pair", "n"), "pair").join(highest, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b"))
        more = met.groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(F.col("id").alias(id_col), *names, "groups")
