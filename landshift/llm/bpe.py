"""Byte-level BPE with word ends: encoding through a lexicon of frequent words, exact merges for the rest, decoding.

Words are counted over all documents; the most frequent ones are compiled with
their ids into a minimal acyclic transducer, which is broadcast (its size is bounded
by the number of words) and memory-mapped by every worker. A word that it does not
know is merged by rank as the vocabulary says, so the lexicon changes the speed only.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from landshift.llm.storage import discard, store
from landshift.llm.transducer import Transducer, compile_words

LEXICON_WORDS = 60_000  # most frequent words compiled, at most; bounds the broadcast to a few MB
CACHED_WORDS = 400_000  # words a worker remembers before it starts afresh
CHUNK = 256  # documents a worker returns at once

SPACE = "\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file; sent to the workers once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.key = uuid.uuid4().hex
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.made = [ids[a + b] for a, b in spec["model"]["merges"]]  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**ids, **self.special}.items()}

    def words(self, text: str) -> Iterator[str | int]:
        """Words of the normalised text in order, and the id of each special string it holds."""
        if self.special and any(s in text for s in self.special):
            # the longest string first, as the leftmost longest one counts
            some = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
            for part in re.split(f"({some})", text):
                if part in self.special:
                    yield self.special[part]
                else:
                    yield from plain_words(part)
        else:
            yield from plain_words(text)

    def merge(self, word: bytes) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers: the lowest rank first, the leftmost of equals."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (lowest := min(ranks)) < none:
            i = ranks.index(lowest)
            ids[i] = self.made[lowest]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return array("I", ids).tobytes()

    def merge_long(self, word: bytes) -> bytes:
        """As `merge`, in time n log n, for words of any length."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        after, before, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return array("I", [i for i in ids if i >= 0]).tobytes()


def plain_words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    # each character is lowered by itself, so a final sigma is no special case
    return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text"):
            counts.update(w for w in shared.value.words(text.as_py()) if type(w) is str)
        for at in range(0, len(counts), 20_000):
            part = list(islice(counts.items(), at, at + 20_000))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])


def word_counts(documents: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, words as the tokenizer cuts them; folded inside each task first."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    texts = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lambda it: _count(it, shared), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """The compiled transducer of the most frequent words, `size` at most.

    Words are taken by steps of a sixteenth of a power of two of their counts, as many
    whole steps as fit, so the driver receives those words and one number per step.
    """
    counts = store(word_counts(documents, vocabulary, text_col).withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    steps = {r.step: r["count"] for r in counts.groupBy("step").count().collect()}
    held, least = 0, None
    for step in sorted(steps, reverse=True):
        held += steps[step]
        if held > size:
            break
        least = step
    rows = [] if least is None else counts.where(F.col("step") >= least).select("word").collect()
    discard(counts)
    words = sorted(r.word.encode() for r in rows)
    return compile_words(words, [vocabulary.merge_long(w) for w in words])


class Encoder:
    def __init__(self, vocabulary: Vocabulary, compiled: bytes) -> None:
        self.vocabulary, self.lexicon = vocabulary, Transducer(compiled)
        self.known: dict[str | int, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        words = list(self.vocabulary.words(text))
        for word in set(words).difference(known):
            known[word] = self._word(word)
        return b"".join(map(known.__getitem__, words))

    def _word(self, word: str | int) -> bytes:
        if isinstance(word, int):
            return array("I", [word]).tobytes()
        data = word.encode()
        if (found := self.lexicon.get(data)) is not None:
            return found
        return self.vocabulary.merge(data) if len(data) < 40 else self.vocabulary.merge_long(data)


_ENCODERS: dict[str, Encoder] = {}  # of this worker; one vocabulary and lexicon at a time


def _encoder(shared) -> Encoder:
    vocabulary, compiled = shared.value
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary, compiled)
    return _ENCODERS[vocabulary.key]


def decode_ids(ids: bytes, tokens: dict[int, str]) -> str:
    """Token strings joined by spaces, which is what a tokenizer without a decoder returns; unknown ids are left out."""
    return " ".join([tokens[i] for i in memoryview(ids).cast("I") if i in tokens])


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(shared)
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            ids = [encoder(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], [*part.schema.names[:-1], "ids"])


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tokens = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            texts = [decode_ids(i.as_py() or b"", tokens) for i in part.column("ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])


def encode_documents(documents: DataFrame, vocabulary: Vocabulary, lexicon: bytes | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row: ids as little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts have no ids; repeated rows and null ids are kept as they are;
    an empty table gives an empty result. Other columns are not read.
    """
    compiled = build_lexicon(documents, vocabulary, text_col=text_col) if lexicon is None else lexicon
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, compiled))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = documents.select(F.col(id_col).alias("id"), text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _encode(it, shared), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded` with the column `decoded`, the token strings of `ids` joined by spaces."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(lambda it: _decode(it, shared), ", ".join([*fields, "decoded string"]))


def encode_decode(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) per row of `documents`."""
    vocabulary = Vocabulary(vocabulary_path)
    out = decode_documents(encode_documents(documents, vocabulary, None, id_col, text_col), vocabulary)
    return out.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4))
