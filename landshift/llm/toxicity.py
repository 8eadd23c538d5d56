"""Toxicity by noisy-channel deobfuscation.

A writer who hides a word replaces letters by look-alikes, repeats them or puts signs
and spaces between them. Each suspicious token, and each run of single characters, is a
lattice of what its characters may stand for; Viterbi search finds the likeliest reading
under a character trigram model counted over all texts. Documents are scored on the words
they show and the words restored, with the weight that labelled documents give to words
and word beginnings.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.storage import discard, store

# What a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
REPLACED, REPEATED, DROPPED, KEPT_RUN, KEPT_GAP = -1.0, -0.5, -3.0, -4.0, -1.0  # log costs of the channel

JOINERS = ".-_"  # may stand between the letters of a word or between words

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIZE = 64  # character classes: white space or sign, the letters above, any other letter
OTHER = len(LETTERS) + 1
SETTLED = 1024  # characters after which what all readings share is settled
BEAM = SIZE**2  # states there are at most; all are kept
PREFIXES = (4, 5)
SUPPORT = 5  # toxic documents a feature must be in
FEATURES = 100_000  # more weights, or FEATURE_CHARS of their names, are joined and not broadcast
FEATURE_CHARS = 4_000_000
FILTER_BITS = 1 << 23  # of the filter that goes before the join
COUNTED = 100_000  # features a task counts before it sends them on
STRENGTH = 6.0  # documents that the base rate counts for
PURITY = 0.8  # least share of toxic documents among those that hold a feature
EVIDENCE = 0.5  # weaker features say nothing
CACHED = 200_000
CACHED_FEATURES = 50_000
COUNTED_CHARS = 2_000_000
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'`()[]{}<>|/\\*#$%&@~^+=_-—–…«»“”„’‘¡¿"

_CLASS = np.zeros(0x250, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _i + 1
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], OTHER)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, dtype=np.int64)

    def add(texts: list[str]) -> None:
        c = classes(f" {' '.join(texts)} ")
        np.add(total, np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3), out=total)

    for batch in batches:
        held: list[str] = []
        size = 0
        for text in batch.column("text"):
            held.append(text.as_py().lower())
            size += len(held[-1])
            if size > COUNTED_CHARS:
                add(held)
                held, size = [], 0
        if held:
            add(held)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def character_model(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a character class after two others, from the trigrams of all texts, smoothed by bigrams.

    The driver receives one count per trigram of classes, of which there are 64**3.
    """
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_count_trigrams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    three = np.zeros(SIZE**3)
    for r in counts:
        three[r.gram] = r.n
    three = three.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + SIZE)
    after_one = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * after_one) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character the readings it allows, with their cost; an empty reading drops it."""
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            ways = [(c, 0.0)]
            if i and token[i - 1] == c:
                long = token[max(0, i - 2):i + 1] == c * 3 or token[i - 1:i + 2] == c * 3
                ways = [(c, KEPT_RUN if long else 0.0), ("", REPEATED if long else DROPPED)]
        elif c == " ":
            ways = [("", 0.0), (" ", KEPT_GAP)]
        elif c in JOINERS:
            ways = [("", REPLACED), (" ", REPLACED + KEPT_GAP)]
        else:
            ways = [(a, REPLACED) for a in LOOKALIKES.get(c, "")] + [("", DROPPED if c in LOOKALIKES else REPLACED)]
        out.append(ways)
    return out


def _spelled(made: tuple | None) -> str:
    parts = []
    while made:
        made, c = made
        parts.append(c)
    return "".join(reversed(parts))


def decode(token: str, model: np.ndarray) -> str:
    """Likeliest reading of a lower-case token of any length, best of its lattice under the character model.

    Readings share their beginnings as linked pairs; what all of them begin with is settled from time to time.
    """
    settled: list[str] = []
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for at, ways in enumerate(lattice(token), 1):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, made) in beam.items():
            for c, cost in ways:
                if c:
                    k = CLASS.get(c, 0 if c == " " else OTHER)
                    state, total, text = (b, k), score + cost + float(model[a, b, k]), (made, c)
                else:
                    state, total, text = (a, b), score + cost, made
                if state not in step or total > step[state][0]:
                    step[state] = (total, text)
        beam = step
        if at % SETTLED == 0:
            texts = {state: _spelled(made) for state, (_, made) in beam.items()}
            settled.append(commonprefix(list(texts.values())))
            beam = {state: (score, (None, texts[state][len(settled[-1]):])) for state, (score, _) in beam.items()}
    ends = [(score + float(model[a, b, 0]), _spelled(made)) for (a, b), (score, made) in beam.items()]
    return "".join(settled) + max(ends)[1]


_DOUBLED = re.compile(r"(.)\1")


def readings(token: str, model: np.ndarray) -> list[str]:
    """Words that a lower-case token may be: itself without outer signs and, unless it is of letters none of which is doubled, its restored form."""
    core = token.strip(EDGE)
    if core.isalpha() and not _DOUBLED.search(core):
        return [core]
    found = [core] if core else []
    if any(map(str.isalpha, token)):
        found += [w for w in decode(token.strip(" .,;:?\"'()[]"), model).split() if w != core]
    return found


def spaced(tokens: list[str]) -> list[str]:
    """Runs of three or more tokens that show a single character each, as one token with gaps."""
    single = [i for i, t in enumerate(tokens) if len(t) == 1 or len(t.strip(EDGE)) == 1]
    runs, run = [], []
    for i in single:
        if run and i != run[-1] + 1:
            runs.append(run)
            run = []
        run.append(i)
    runs.append(run)
    return [" ".join(tokens[i].strip(EDGE) or tokens[i] for i in r) for r in runs if len(r) > 2]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


class Features(dict):
    """Features of the words that a token may be."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def of(self, token: str) -> set[str]:
        return {f for word in readings(token, self.model) for f in features(word)}

    def __missing__(self, token: str) -> set[str]:
        if len(self) > CACHED_FEATURES:
            self.clear()
        self[token] = out = self.of(token)
        return out

    def document(self, text: str | None) -> set[str]:
        tokens = text.lower().split() if text else []
        return set().union(*map(self.__getitem__, set(tokens)), *map(self.of, spaced(tokens)))


def _count_features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents that hold a feature."""
    found, counts = Features(shared.value), (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            counts[bool(toxic.as_py())].update(found.document(text.as_py()))
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield out()
    yield out()


class ToxicityModel:
    """Character model, weight of each feature (the share of toxic documents among those that hold it) and base rate."""

    def __init__(self, characters: np.ndarray, weights: dict[str, float], base: float) -> None:
        self.characters, self.weights, self.base = characters, weights, base
        self.known: dict[str, float] = {}
        self.key = uuid.uuid4().hex

    def token_score(self, token: str) -> float:
        get = self.weights.get
        return max([get(f, 0.0) for word in readings(token, self.characters) for f in features(word)], default=0.0)

    def score(self, text: str | None) -> float:
        tokens = text.lower().split() if text else []
        if len(self.known) > CACHED:
            self.known.clear()
        known, different = self.known, set(tokens)
        for token in different.difference(known):
            known[token] = self.token_score(token)
        best = max(map(known.__getitem__, different), default=0.0)
        for run in spaced(tokens):
            best = max(best, self.token_score(run))
        return max(best, self.base)


def fit(labelled: DataFrame, characters: np.ndarray) -> tuple[DataFrame, float]:
    """Weights (feature, weight), a stored table that grows with the rows, and the base rate, from rows (text, toxic 0/1) without nulls."""
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = min(0.4, (toxic + 0.5) / (toxic + clean + 1)) / 2
    shared = labelled.sparkSession.sparkContext.broadcast(characters)
    counts = labelled.where(F.col("toxic").isin(0, 1)).select("text", "toxic").mapInArrow(lambda it: _count_features(it, shared), "feature string, toxic bigint, clean bigint")
    held = store(counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= SUPPORT))
    # a beginning that one word accounts for says no more than the word
    begins = F.array_compact(F.array(*[F.when(F.length("feature") >= n, F.concat(F.substring("feature", 1, n), F.lit("-"))) for n in PREFIXES]))
    words = held.where(~F.col("feature").endswith("-")).select(F.explode(begins).alias("feature"), "toxic").groupBy("feature").agg(F.max("toxic").alias("most"))
    own = held.join(words, "feature", "left").where(F.col("most").isNull() | (2 * F.col("most") < F.col("toxic")))
    every = F.col("toxic") + F.col("clean")
    weight = (F.col("toxic") + F.lit(STRENGTH * toxic / max(1, toxic + clean))) / (every + F.lit(STRENGTH))
    weights = store(own.where(F.col("toxic") >= F.lit(PURITY) * every).select("feature", weight.alias("weight")).where(F.col("weight") > EVIDENCE))
    discard(held)
    return weights, base


_MODELS: dict[str, ToxicityModel] = {}  # of this worker, so that token scores outlive a task


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    if shared.value.key not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.value.key] = shared.value
    model = _MODELS[shared.value.key]
    for batch in batches:
        scores = [model.score(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])


def feature_filter(weights: DataFrame) -> np.ndarray:
    """A bit for each hash of a feature, in words of 64; the driver receives one row per word, of which there are FILTER_BITS / 64."""
    bits = weights.select(F.pmod(F.xxhash64("feature"), F.lit(FILTER_BITS)).alias("bit"))
    words = bits.groupBy(F.expr("bit DIV 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("word")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words:
        out[r["at"]] = r.word
    return out


def _held(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """In place of a text those of its features that the filter lets through."""
    characters, bits = shared.value
    found, words = Features(characters), bits.view(np.uint64).tolist()

    def passes(feature: str) -> int:
        at = xxhash.xxh64_intdigest(feature.encode("utf-8", "replace"), 42) % FILTER_BITS
        return words[at >> 6] >> (at & 63) & 1

    for batch in batches:
        held = [list(filter(passes, found.document(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.list_(pa.string()))], [*batch.schema.names[:-1], "features"])


def predict(documents: DataFrame, characters: np.ndarray, weights: DataFrame, base: float, keep: list[Column], text_col: str = "text") -> DataFrame:
    """`keep` of every row with score (the base rate for null, empty and unsuspicious texts) and predicted.

    Few weights are broadcast; more are joined with the features of the rows, with the same scores.
    """
    context = documents.sparkSession.sparkContext
    text = F.col(text_col).cast("string").alias("text")
    n, chars = weights.agg(F.count(F.lit(1)), F.sum(F.length("feature"))).first()
    if n <= FEATURES and (chars or 0) <= FEATURE_CHARS:
        shared = context.broadcast(ToxicityModel(characters, {r.feature: r.weight for r in weights.collect()}, base))
        rows = documents.select(*keep, text)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
        out = rows.mapInArrow(lambda it: _score(it, shared), ", ".join([*fields, "score double"]))
    else:
        shared = context.broadcast((characters, feature_filter(weights)))
        rows = documents.select(*keep, F.monotonically_increasing_id().alias("_row"), text)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
        held = store(rows.mapInArrow(lambda it: _held(it, shared), ", ".join([*fields, "features array<string>"])))
        best = held.select("_row", F.explode("features").alias("feature")).join(weights, "feature").groupBy("_row").agg(F.max("weight").alias("_best"))
        score = F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(base)).alias("score")
        out = held.join(best, "_row", "left").select(*[F.col(f"`{f.name}`") for f in rows.schema.fields[:-2]], score)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is kept out of learning; one without an id has no label and is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every document, learned from the labels of those that are not held out.

    A document with several labels counts with the largest. Without labels every score
    is a base rate below one half; an empty table gives an empty result.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    texts = documents.where(F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # the labels grow with the documents, so their join is never a broadcast
    labelled = store(texts.join(marked.hint("merge"), "_id").select("text", "toxic"))
    characters = character_model(documents, text_col)
    weights, base = fit(labelled, characters)
    discard(labelled)
    return predict(documents, characters, weights, base, [F.col(id_col), held_out(id_col).alias("held_out")], text_col)
