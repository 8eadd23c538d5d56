"""Similarity join of documents on word n-grams by PartEnum signatures.

Sets whose Jaccard similarity reaches the threshold differ in a bounded number k of
elements, which the band of their sizes gives. The domain of all n-grams is cut, by hash, into
first-level parts and each of them into second-level parts. Among enough first-level parts
one holds few of the differences, and then some subset of its second-level parts holds none: the
two sets agree there. So a signature is the content of one such subset, and sets that are
similar enough share one. Sets of neighbouring bands meet in the bands' common instance.

Documents that share a signature are not paired with each other. Every group of a signature,
in parts if it is large, names hubs; members are compared with their hub on the n-grams
themselves, and what turns out to be linked becomes one component. The members of groups that hold
more than one component are grouped anew by their rarest n-grams, since sets that are similar enough
share one of those too: a cloud of texts that have most n-grams in common falls apart there. These
groups go on with further hubs, chosen from their smaller components (all members that can be the
smaller set of a pair, if these are few), until every pair that could still join two components was
compared. A bitmap of each set, whose bits tell parities, bounds from below how many n-grams two sets
differ in, so what remains of a cloud below the threshold is told apart without reading its texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.llm.components import connected_components
from landshift.llm.storage import discard, store, store_by_key

SHINGLE = 3
PERCENT = 90  # links: 100 * intersection >= PERCENT * union
FEW = 8  # members of a group, or of its part, that share a hub in the first round
HUBS = 16  # of a larger group in one round, or as many as give that many places if that is more
PAIRS = 65536
ROUND = 64  # times PAIRS: so many places compared in one round of a group; up to it, all its leading members are hubs at once
WORDS = 16  # of 64 bits in a set's bitmap
SMALL = 8  # up to so many differences, larger subsets make up for small sets

_ODD, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shingles(line: bytes, width: int = SHINGLE) -> set[bytes]:
    """Distinct word n-grams of words joined by single spaces; fewer words are one n-gram."""
    if not line:
        return set()
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    ends = [*gaps.tolist(), len(line)]
    if len(ends) <= width:
        return {line}
    return {line[a:b] for a, b in zip([0, *(gaps + 1).tolist()], ends[width - 1:])}


class Bands:
    """Size bands, each as wide as the threshold lets two sets of it differ in size."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.starts = percent, [1]

    def _up_to(self, size: int) -> None:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(instance, most differences) that a set of this size takes part in: its own band's, and the next one's if it reaches it."""
        largest = size * 100 // self.percent
        self._up_to(largest + 1)
        band = bisect_right(self.starts, size) - 1
        last = bisect_right(self.starts, largest) - 1
        return [(i, 2 * (self.starts[i + 1] - 1) * (100 - self.percent) // (100 + self.percent)) for i in range(band, last + 1)]


def shape(k: int) -> tuple[int, int, int, int]:
    """(first-level parts, second-level parts, how many of these may differ, spare first-level parts) for k differences."""
    if k == 0:
        return 1, 1, 0, 1
    second, spare = (3, 1) if k <= SMALL else (2, 2)
    return k // 2 + spare, second, 1, spare


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set of 64-bit element hashes.

    Subsets without an element are left out where a pair must still share another one:
    `spare` first-level parts hold few differences, so it suffices that fewer parts have an empty subset.
    """
    out = []
    for instance, k in bands.instances(len(hashes)):
        first, second, differ, spare = shape(k)
        parts = first * second
        at = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        sums = np.zeros(parts, dtype=np.uint64)
        np.add.at(sums, at.astype(np.int64), _mix(hashes))
        held = np.bincount(at.astype(np.int64), minlength=parts).reshape(first, second)
        sums = sums.reshape(first, second)
        chosen = list(combinations(range(second), second - differ))
        content = np.stack([sums[:, list(c)].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1)
        empty = np.stack([held[:, list(c)].sum(axis=1) == 0 for c in chosen], axis=1)
        number = np.arange(content.size, dtype=np.uint64).reshape(content.shape) + (np.uint64(instance) << np.uint64(32))
        marks = _mix(content * _ODD + _mix(number * _ODD))
        keep = ~empty if empty.any(axis=1).sum() < spare else np.ones_like(empty)
        out.append(marks[keep])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    bands = Bands(percent)
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, marks = [], []
            for line in part.column("line"):
                grams = shingles(line.as_py(), width)
                hashes = np.fromiter(map(digest, grams), np.uint64, len(grams))
                sizes.append(len(grams))
                # elements whose hashes are equal count as one here; the comparison reads the n-grams
                marks.append(signatures(hashes, bands).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["row", "n", "sigs"])


def _linked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, left = None, set()
    for batch in batches:
        found = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            if a != last:
                last, left = a, shingles(batch.column("line_a")[i].as_py(), width)
            right = shingles(batch.column("line_b")[i].as_py(), width)
            both = len(left & right)
            if 100 * both >= percent * (len(left) + len(right) - both):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, lines: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. A popular hub `a` is a skewed key between written tables, which Spark splits."""
    hubs = store(lines.join(pairs.select(F.col("a").alias("row")).distinct(), "row").select(
        F.col("row").alias("a"), F.col("line").alias("line_a"), F.col("n").alias("n_a")))
    with_a = pairs.join(hubs, "a")
    small, large = F.least("n_a", "n"), F.greatest("n_a", "n")
    with_both = with_a.join(lines.select(F.col("row").alias("b"), F.col("line").alias("line_b"), "n"), "b").where(small * 100 >= large * percent)
    out = store(with_both.select("a", "b", "line_a", "line_b").mapInArrow(lambda it: _linked(it, width, percent), "a bigint, b bigint"))
    discard(hubs)
    return out


def _divided(rest: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their label and groups (sig, size, leads) of the groups that hold more than one component, and a leading member."""
    labelled = store(rest.join(roots.withColumnRenamed("node", "row"), "row", "left").select(*rest.columns, F.coalesce("root", "row").alias("label")))
    groups = store(labelled.groupBy("sig").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.count_if("lead").alias("leads"))
        .where("low < high AND leads > 0").select("sig", "size", "leads"))
    members = store(labelled.join(groups.select("sig"), "sig", "left_semi"))
    discard(labelled)
    return members, groups


def _grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [np.unique(np.fromiter(map(digest, shingles(line.as_py(), width)), np.uint64)) for line in part.column("line")]
            lists = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), bitmap)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("n"), *lists], ["row", "n", "grams", "bits"])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit per bucket of hashes, set if it holds an odd number of a set's elements.

    Elements of both of two sets cancel out and one of a single set turns one bit at most, so two
    bitmaps differ in no more bits than the sets in elements, whatever their sizes.
    """
    odd = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(a: str, b: str, sizes: Column, percent: int) -> Column:
    """True if two bitmaps differ in no more bits than linked sets that add up to `sizes` may differ in elements."""
    differ = reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)])
    return differ * (100 + percent) <= sizes * (100 - percent)


def _enough(after: Column, sizes: Column, percent: int) -> Column:
    """True if sets that add up to `sizes` can link with one common element and `after` behind it."""
    return (after + 1) * (100 + percent) >= sizes * percent


def _by_rare_grams(rows: DataFrame, lines: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, row, n, place, lead, bits) with the rarest n-grams of each row as `sig`, as many as leave too few others for a link.

    Of n n-grams a linked set lacks floor(n * (100 - percent) / 100) at most. Both sets order theirs
    alike, so the first they share stands among the first of both, one more than may be lacking;
    n-grams whose hashes are equal count as one, which leaves fewer others still. Of a linked pair the
    smaller set leads: from the first n-gram they share on, it holds enough for a link with a set of its own size.
    """
    sets = store(rows.join(lines, "row").select("row", "line", "n").mapInArrow(
        lambda it: _grams(it, width), "row bigint, n bigint, grams array<bigint>, bits array<bigint>"))
    held = sets.select("row", "n", F.explode("grams").alias("sig"))
    counted = held.join(held.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig")
    place = F.row_number().over(Window.partitionBy("row").orderBy("df", "sig"))
    first = counted.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1)
    lead = _enough(F.col("n") - F.col("place"), 2 * F.col("n"), percent)
    out = store(first.where("df > 1").join(sets.select("row", "bits"), "row").select("sig", "row", "n", "place", lead.alias("lead"), "bits"))
    discard(sets)
    return out


def _components(lines: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of every row that is linked with another one."""
    sigs = signed.select(F.explode("sigs").alias("sig"), "row")
    shared = store(sigs.groupBy("sig").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("n"))
                   .where("low < high").select("sig", "n"))
    # a large group is dealt into small parts, in another way for each signature, so that a cloud of copies soon hangs together
    part = F.pmod(F.xxhash64("row", "sig"), F.ceil(F.col("n") / FEW))
    members = store(sigs.join(shared, "sig").select("sig", "row", part.alias("part")))
    first = store(members.groupBy("sig", "part").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "part", "hub"))
    tested = store(members.join(first, ["sig", "part"]).where("row != hub").select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct())
    links = _verified(tested, lines, width, percent)
    roots = store(connected_components(links))
    before, (members, _) = members, _divided(members.select("sig", "row", F.lit(True).alias("lead")), roots)
    discard(before)
    if members.isEmpty():
        return roots
    before, members = members, _by_rare_grams(members.select("row").distinct(), lines, width, percent)
    discard(before)
    rest = members
    while True:
        before, (members, groups) = members, _divided(rest, roots)
        discard(before)
        if members.isEmpty():
            return roots
        bounded = F.col("leads") * F.col("size") <= ROUND * PAIRS
        leading = members.where("lead").join(groups.where(bounded), "sig", "left_semi")
        parts = store(members.join(groups.where(~bounded), "sig", "left_semi").groupBy("sig", "label").agg(F.count(F.lit(1)).alias("of"), F.min("row").alias("row")))
        # the largest component of a group needs no hub: all others are compared with its members
        order = Window.partitionBy("sig").orderBy("of", "row")
        first = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROUND * PAIRS // 2)
        labels = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("labels")).join(groups, "sig")
        some = (F.col("rank") < F.col("labels")) & (F.col("rank") <= F.greatest(F.lit(HUBS), F.floor(ROUND * PAIRS / F.col("size"))))
        chosen = members.join(first.join(labels, "sig").where(some), ["sig", "row"], "left_semi")
        hubs = store(leading.unionByName(chosen).select("sig", *[F.col(c).alias(f"hub_{c}") for c in ("row", "label", "n", "place", "bits")]))
        # before the first n-gram two sets share they share none, and pairs that do meet there as well
        sizes = F.col("hub_n") + F.col("n")
        able = _enough(F.least(F.col("hub_n") - F.col("hub_place"), F.col("n") - F.col("place")), sizes, percent) & _near("hub_bits", "bits", sizes, percent)
        ends = [F.least("hub_row", "row").alias("a"), F.greatest("hub_row", "row").alias("b")]
        pairs = store(members.join(hubs, "sig").where((F.col("label") != F.col("hub_label")) & able).select(*ends).distinct()
                      .join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        more = _verified(pairs, lines, width, percent)
        if not more.isEmpty():
            roots = _merged(roots, more)
        rest = members.join(hubs.select("sig", F.col("hub_row").alias("row")), ["sig", "row"], "left_anti").drop("label")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links, which are followed between components, not rows."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(end, F.coalesce(f"root_{end}", end))
    joined = store(connected_components(ends.select("a", "b")))
    after = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    alone = joined.join(roots.select("node"), "node", "left_anti")
    return store(after.unionByName(alone.select("node", "root")))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row, by links between sets of at least `percent` percent Jaccard similarity.

    Words are what ASCII white space parts, A-Z in lower case. component_id is the smallest id
    that links reach, the row's own included; null where none of them has an id. Null texts
    and texts without words have an empty set, which links with nothing, not even another one.
    Rows with the same words are one node; rows with one id keep a result each. An empty table
    gives an empty result. Other columns are not read.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and up to 100")
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    line = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")).cast("binary")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), line.alias("line"))
    texts = store_by_key(rows.select("*", F.unhex(F.sha2("line", 256)).alias("words")), "row")
    classes = store(texts.groupBy("words").agg(F.min("row").alias("row"), F.min("id").alias("least")))
    some = texts.select("row", "line").join(classes.select("row"), "row").where(F.octet_length("line") > 0)
    signed = store_by_key(some.mapInArrow(lambda it: _sign(it, width, percent), "row bigint, n bigint, sigs array<bigint>"), "row")
    lines = texts.select("row", "line").join(signed.select("row", "n"), "row")
    roots = _components(lines, signed, width, percent)
    named = store(classes.join(signed.select("row", "n"), "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
                  .select("words", "least", F.coalesce("root", "row").alias("root"), F.coalesce("n", F.lit(0)).alias("n")))
    least = store(named.groupBy("root").agg(F.min("least").alias("component_id")))
    found = store(named.join(least, "root").select("words", "n", "component_id"))
    discard(signed, named, least, classes)
    return texts.select("id", "words").join(found, "words").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
