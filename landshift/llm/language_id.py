"""Language identification by segmentation-marginalised unigrams.

A word is a sequence of pieces of a fixed public vocabulary. Each language has its own
piece probabilities, and the probability of a word is the sum over all its segmentations,
found by the forward algorithm. Probabilities are fitted by expectation-maximisation over
the word counts of every training document; a text goes to the language that makes it
likeliest. Pieces do not cross white space, so words are scored once per batch and summed.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.storage import discard, store

ROUNDS = 2  # of expectation-maximisation
SHORT = 40  # words of more characters are summed in logarithms, one by one, with equal results
SCALE = 100.0  # weight a character, so that sums over short words stay in range
CACHED_WORDS = 300_000  # words whose likelihoods a worker remembers before it starts afresh
UNSEEN = 1e-8  # probability of a character that no piece covers
SMOOTHING = 0.05  # added to each expected piece count
UNDETERMINED = "und"
CHUNK_CHARS = 4_000_000  # of texts split into words at once; bounds a worker's memory
MICRO = 1e6

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 22


class Pieces:
    """The vocabulary as hashes of its pieces; `find` gives the number of each hash, or the count of pieces."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        codes = np.array([self._code(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.count = len(pieces)
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[self._slot(self.codes)] = True

    @staticmethod
    def _code(piece: str) -> int:
        code = 0
        for c in piece:
            code = (code * int(_P) + ord(c) + 1) % (1 << 64)
        return code

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes ^ (codes >> np.uint64(31))) * _Q) >> np.uint64(64 - _FILTER_BITS)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 where there is none."""
        if not self.count:
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), self.count - 1)
        return np.where(self.codes[at] == codes, self.order[at], -1)

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in `words`, which are equally long; an uncovered character is one edge."""
        length = len(words[0])
        chars = np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        for start in range(length):
            code = np.zeros(len(words), dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                code = code * _P + chars[:, end - 1]
                rows = np.flatnonzero(self.maybe[self._slot(code)])
                at = np.minimum(np.searchsorted(self.codes, code[rows]), self.count - 1) if self.count else rows[:0]
                hit = self.codes[at] == code[rows] if self.count else np.zeros(0, dtype=bool)
                rows, at = rows[hit], at[hit]
                if end == start + 1:
                    rest = np.setdiff1d(np.arange(len(words)), rows, assume_unique=True)
                    if len(rest):
                        yield start, end, rest, np.full(len(rest), self.count)
                if len(rows):
                    yield start, end, rows, self.order[at]


def vocabulary_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(length, places, words with the sign of a word's start) of equally long words; long ones come one by one."""
    groups: dict[int, tuple[list[int], list[str]]] = defaultdict(lambda: ([], []))
    for i, word in enumerate(words):
        if len(word) < SHORT:
            rows, some = groups[len(word) + 1]
            rows.append(i)
            some.append("▁" + word)
        else:
            yield len(word) + 1, [i], ["▁" + word]
    for length, (rows, some) in groups.items():
        yield length, rows, some


def _edges_at(word: str, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each end in a word: the starts of the pieces that end there, and their numbers."""
    found: list[tuple[list[int], list[int]]] = [([], []) for _ in range(len(word) + 1)]
    codes = np.array([ord(c) for c in word], dtype=np.uint64) + np.uint64(1)
    code = np.zeros(len(word), dtype=np.uint64)
    for size in range(1, min(len(word), pieces.longest) + 1):
        starts = len(word) - size + 1
        code = code[:starts] * _P + codes[size - 1:]
        hits = pieces.find(code)
        for start in np.flatnonzero(hits >= 0).tolist():
            found[start + size][0].append(start)
            found[start + size][1].append(int(hits[start]))
        if size == 1:
            for start in np.flatnonzero(hits < 0).tolist():
                found[start + 1][0].append(start)
                found[start + 1][1].append(pieces.count)
    return [(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for a, b in found]


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=0)
    return top + np.log(np.exp(values - top).sum(axis=0))


def _log_forward(edges: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> np.ndarray:
    forward = np.zeros((len(edges), logs.shape[1]))
    for end in range(1, len(edges)):
        starts, piece = edges[end]
        forward[end] = _log_sum(forward[starts] + logs[piece])
    return forward


def log_likelihood(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language (column of `probs`, whose last row is for uncovered characters)."""
    out = np.zeros((len(words), probs.shape[1]))
    for length, rows, some in _by_length(words):
        if length > SHORT:
            out[rows[0]] = _log_forward(_edges_at(some[0], pieces), np.log(probs))[-1]
            continue
        forward = np.zeros((length + 1, len(some), probs.shape[1]))
        forward[0] = 1
        for start, end, at, piece in pieces.edges(some):
            forward[end][at] += forward[start][at] * probs[piece] * SCALE ** (end - start)
        out[rows] = np.log(forward[length]) - length * np.log(SCALE)
    return out


def _long_counts(word: str, weight: float, language: int, pieces: Pieces, logs: np.ndarray, total: np.ndarray) -> None:
    edges = _edges_at(word, pieces)
    logs = logs[:, language:language + 1]
    forward = _log_forward(edges, logs)
    back = np.full(forward.shape, -np.inf)
    back[-1] = 0
    for end in range(len(edges) - 1, 0, -1):
        starts, piece = edges[end]
        back[starts] = np.logaddexp(back[starts], back[end] + logs[piece])  # each start once
        total[piece, language] += weight * np.exp(forward[starts] + logs[piece] + back[end] - forward[-1])[:, 0]


def expected_counts(words: list[str], weights: np.ndarray, languages: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in each language's words, over all segmentations."""
    total = np.zeros(probs.shape)
    flat = total.reshape(-1)
    for length, rows, some in _by_length(words):
        language, weight = languages[rows], weights[rows]
        if length > SHORT:
            _long_counts(some[0], weight[0], int(language[0]), pieces, np.log(probs), total)
            continue
        forward, back = np.zeros((2, length + 1, len(some)))
        forward[0], back[length] = 1, 1
        edges = [(s, e, at, piece, probs[piece, language[at]] * SCALE ** (e - s)) for s, e, at, piece in pieces.edges(some)]
        for start, end, at, _, p in edges:
            forward[end][at] += forward[start][at] * p
        for start, end, at, _, p in reversed(edges):
            back[start][at] += back[end][at] * p
        share = weight / forward[length]
        for start, end, at, piece, p in edges:
            flat += np.bincount(piece * probs.shape[1] + language[at], forward[start][at] * p * back[end][at] * share[at], probs.size)
    return total


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter[str]] = defaultdict(Counter)
        for language, text in zip(batch.column("lang"), batch.column("text")):
            counts[language.as_py()].update(text.as_py().split())
        for language, words in counts.items():
            items = iter(words.items())
            while some := list(islice(items, 20_000)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([language] * len(some), pa.string()), pa.array([w for w, _ in some], pa.string()),
                    pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])


def _expect(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    pieces, probs, languages = shared.value
    number = {language: i for i, language in enumerate(languages)}
    total = np.zeros(probs.shape)
    for batch in batches:
        language = np.array([number[v] for v in batch.column("lang").to_pylist()], dtype=np.int64)
        weights = batch.column("n").to_numpy().astype(float)
        total += expected_counts(batch.column("word").to_pylist(), weights, language, pieces, probs)
    piece, language = np.nonzero(total[:-1])
    micro = np.rint(total[piece, language] * MICRO).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(micro)], ["piece", "language", "micro"])


class LanguageModel:
    """Piece probabilities of each language: `probs[piece, language]`, the last row for uncovered characters."""

    def __init__(self, pieces: Pieces, languages: list[str], probs: np.ndarray) -> None:
        self.pieces, self.languages, self.probs = pieces, languages, probs
        self.key = uuid.uuid4().hex


class KnownWords:
    """Likelihoods of the words that a worker has met lately: `place` gives their rows in `logs`."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.place) > CACHED_WORDS:
            self.place, self.logs = {}, self.logs[:0]
        new = list(words.difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.logs = np.concatenate([self.logs, log_likelihood(new, self.model.pieces, self.model.probs)])


_KNOWN: dict[str, KnownWords] = {}  # of this worker; one model at a time


def _known(model: LanguageModel) -> KnownWords:
    if model.key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.key] = KnownWords(model)
    return _KNOWN[model.key]


def fit(training: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> LanguageModel:
    """A model from rows (lang, text) without nulls, over all of them.

    The driver sees one number per piece and language, which the vocabulary bounds.
    """
    pieces = Pieces(vocabulary_pieces(vocabulary_path))
    counts = store(training.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in training.select("lang").distinct().collect())
    probs = np.full((pieces.count + 1, len(languages)), 1 / max(1, pieces.count))
    probs[-1] = UNSEEN
    for _ in range(rounds if languages else 0):
        shared = training.sparkSession.sparkContext.broadcast((pieces, probs, languages))
        sums = counts.mapInArrow(lambda it, s=shared: _expect(it, s), "piece bigint, language bigint, micro bigint")
        found = sums.groupBy("piece", "language").agg(F.sum("micro").alias("micro")).collect()
        expected = np.zeros((pieces.count, len(languages)))
        for r in found:
            expected[r.piece, r.language] = r.micro / MICRO
        probs[:-1] = (expected + SMOOTHING) / (expected.sum(axis=0) + SMOOTHING * pieces.count)
        shared.unpersist()
    discard(counts)
    return LanguageModel(pieces, languages, probs)


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    """Likeliest language and its posterior under equal priors for each text."""
    split = [t.split() if t and any(map(str.isalpha, t)) else [] for t in texts]
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = _known(model)
    known.learn(set().union(*split))
    place, logs = known.place, known.logs
    names, scores = [], []
    for some in split:
        if not some:
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        total = logs[list(map(place.__getitem__, some))].sum(axis=0)
        best = int(total.argmax())
        names.append(model.languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return names, scores


def _classify(batches: Iterator[pa.RecordBatch], shared, with_text: bool) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        sizes = np.cumsum([len(t.as_py() or "") for t in batch.column("text")]) // CHUNK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        kept = batch.num_columns if with_text else batch.num_columns - 1
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            names, scores = classify(part.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:kept], "lang_pred", "score"])


def predict(documents: DataFrame, model: LanguageModel, keep: list[Column], text_col: str = "text", with_text: bool = False) -> DataFrame:
    """`keep` of every row, its text if asked for, lang_pred and score.

    A null text and one without a letter is `und` with score 0, as is everything when no
    language was learned. Repeated rows and null ids stay; an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col(text_col).cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:None if with_text else -1]]
    return rows.mapInArrow(lambda it: _classify(it, shared, with_text), ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept out of learning; one without an id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_languages(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the labelled rows that are not held out."""
    learn = documents.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit(learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), vocabulary_path)
    return predict(documents, model, [F.col(id_col), held_out(id_col).alias("held_out")], text_col)


def keep_identified(documents: DataFrame, vocabulary_path: str, least: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `documents`, all columns, whose language is found with at least the given score."""
    learn = documents.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit(learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), vocabulary_path)
    names = {c: f"c{i}" for i, c in enumerate(documents.columns) if c != text_col}
    found = predict(documents, model, [F.col(c).alias(n) for c, n in names.items()], text_col, with_text=True)
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*[F.col(names.get(c, "text")).alias(c) for c in documents.columns])
