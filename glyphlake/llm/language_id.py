"""Operator 5: language identification by unigrams over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities: a forward recursion over the word's bytes gives
it. A text's score is the sum of its words' log probabilities. Byte pieces are in
the vocabulary, so any text has a score.

The probabilities are fitted by expectation maximisation (expected piece counts
over all segmentations, by the forward and backward recursions) to a sample of
``sample`` documents of each language, those with the least hashes among the
labelled ones; this bound is the only one. The model ``und`` has one probability
for all pieces: text that it explains best is of none of the languages.

Defined results: a null or blank text has no score and is ``und``. Where there is
nothing to fit to (no labelled row, an empty table) there is no model: every text
is ``und``. Words are scored whole, however long (scripts without spaces have
sentences for words); of the sample, words of over ``FITTED`` bytes are not fitted
to. Very long texts are scored whole, one at a time. Equal scores go to the
language that is first by name. Repeated rows have equal results. Extra columns
stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C, words as W

U64 = np.uint64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 300
#: Bytes of the longest words of the sample that the model is fitted to.
FITTED = 1024
ROUNDS = 3
#: Bytes of text that are scored at once.
PIECE = (2 << 20) - 4096
#: Factor per byte that keeps products of probabilities within the range of doubles, over EVERY bytes at least.
SCALE = 12.0
EVERY = 16
#: Bytes up to which words of one length are scored side by side; up to which words of similar lengths are.
SHORT, MIDDLE = 32, 1024
UND = "und"
_BASE = 0x9E3779B97F4A7C15


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces as bytes, with a space for the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.add(bytes([int(piece[3:-1], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i)):
            text = piece.replace("▁", " ").encode()
            if text.rfind(b" ") <= 0:  # no word has a space within
                found.add(text)
    return sorted(found | {bytes([b]) for b in range(256)})


def _hash(matrix: np.ndarray) -> np.ndarray:
    """Of each row of bytes."""
    return W.mix((matrix.astype(U64) + U64(1)) @ W.powers(_BASE, matrix.shape[1]) + U64(matrix.shape[1]))


@dataclass
class Pieces:
    """Finds all pieces that a word has, by their hashes in an open table."""

    pieces: list[bytes]
    table: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)
    lengths: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = sorted({len(p) for p in self.pieces})
        hashes = np.zeros(len(self.pieces), U64)
        for n in self.lengths:
            these = [i for i, p in enumerate(self.pieces) if len(p) == n]
            hashes[these] = _hash(np.frombuffer(b"".join(self.pieces[i] for i in these), np.uint8).reshape(-1, n))
        self.keys = hashes
        size = 1 << 21
        self.table = np.full(size, -1, np.int32)
        self.more: dict[int, int] = {}
        for i, h in enumerate(hashes.tolist()):
            slot = h >> 43
            if self.table[slot] < 0:
                self.table[slot] = i
            else:
                self.more[h] = i
        self.extra = np.array(sorted(self.more), U64)
        self.extra_id = np.array([self.more[h] for h in sorted(self.more)], np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        found = self.table[(hashes >> U64(43)).astype(np.int64)]
        missed = np.flatnonzero((found >= 0) & (self.keys[found] != hashes))
        if len(missed):
            found = found.copy()
            at = np.minimum(np.searchsorted(self.extra, hashes[missed]), len(self.extra) - 1)
            found[missed] = np.where(self.extra[at] == hashes[missed], self.extra_id[at], -1)
        return found

    def lattice(self, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) for all words of a length, in the order of end."""
        n = matrix.shape[1]
        terms = (matrix.astype(U64) + U64(1)) * W.powers(_BASE, n)
        sums = np.zeros((len(matrix), n + 1), U64)
        np.cumsum(terms, axis=1, out=sums[:, 1:])
        back = W.powers(W.inverse(_BASE), n + 1)
        for end in range(1, n + 1):
            for length in self.lengths:
                if length > end:
                    break
                begin = end - length
                piece = self.find(W.mix((sums[:, end] - sums[:, begin]) * back[begin] + U64(length)))
                has = np.flatnonzero(piece >= 0)
                if len(has):
                    yield begin, end, has, piece[has]


def forward(pieces: Pieces, scaled: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled probabilities [place, word, language]; the words' probabilities, as logarithms; and the logarithms that the places were divided by.

    A row of the matrix is a word, filled up behind its length.
    """
    n, kinds = matrix.shape[1], scaled.shape[1]
    alpha = np.zeros((n + 1, len(matrix), kinds))
    taken = np.zeros((n + 1, len(matrix), kinds)) if n > EVERY else np.zeros((n + 1, 1, 1))
    out = np.zeros((len(matrix), kinds))
    alpha[0] = 1
    last = 0

    def close(end: int) -> None:
        nonlocal last
        for e in range(last + 1, end + 1):
            done = np.flatnonzero(lengths == e)
            if len(done):
                out[done] = np.log(alpha[e, done]) + (taken[e, done] if n > EVERY else 0)
        last = end

    steps = pieces.lattice(matrix)
    held = next(steps, None)
    for end in range(1, n + 1):
        if n > EVERY:
            taken[end] = taken[end - 1]
        while held is not None and held[1] == end:
            begin, _, which, piece = held
            if n > EVERY:
                alpha[end, which] += alpha[begin, which] * scaled[piece] * np.exp(np.minimum(taken[begin, which] - taken[end, which], 690))
            elif len(which) == len(matrix):
                alpha[end] += alpha[begin] * scaled[piece]
            else:
                alpha[end, which] += alpha[begin, which] * scaled[piece]
            held = next(steps, None)
        if n > EVERY and end % EVERY == 0:
            top = np.maximum(alpha[end], 1e-300)
            alpha[end] /= top
            taken[end] += np.log(top)
    close(n)
    return alpha, out, taken


def long_word(pieces: Pieces, scaled: np.ndarray, word: np.ndarray, block: int = 4096) -> np.ndarray:
    """The logarithms of one long word's scaled probabilities, in a window as long as the longest piece."""
    reach, kinds = pieces.lengths[-1], scaled.shape[1]
    lengths = np.array(pieces.lengths)
    window = np.zeros((reach + block + 1, kinds))
    window[reach] = 1
    taken = np.zeros(kinds)
    for a in range(0, len(word), block):
        ends = np.arange(a + 1, min(a + block, len(word)) + 1)
        low = max(0, a - reach)
        terms = (word[low : ends[-1]].astype(U64) + U64(1)) * W.powers(_BASE, ends[-1] - low)
        sums = np.concatenate([[U64(0)], np.cumsum(terms, dtype=U64)])
        back = W.powers(W.inverse(_BASE), len(sums))
        p = np.zeros((len(ends), len(lengths), kinds))
        for j, length in enumerate(pieces.lengths):
            some = np.flatnonzero(ends >= length)
            begin = ends[some] - length - low
            found = pieces.find(W.mix((sums[begin + length] - sums[begin]) * back[begin] + U64(length)))
            has = found >= 0
            p[some[has], j] = scaled[found[has]]
        for i in range(len(ends)):
            x = window[reach + 1 + i - lengths]
            x *= p[i]
            window[reach + 1 + i] = x.sum(axis=0)
            if i % EVERY == EVERY - 1 or i == len(ends) - 1:
                top = np.maximum(window[reach + 1 + i], 1e-300)
                seen = window[max(0, i + 1 - reach) : reach + 2 + i]
                top = np.maximum(top, seen.max(axis=0) * 1e-250)  # no overflow of what no piece reaches any more
                seen /= top
                taken += np.log(top)
        window[: reach + 1] = window[len(ends) : len(ends) + reach + 1].copy()
    return np.log(window[reach]) + taken


def expected_counts(pieces: Pieces, scaled: np.ndarray, matrix: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece; weight: how often each language has each word."""
    n = matrix.shape[1]
    alpha, whole, taken = forward(pieces, scaled, matrix, lengths)
    beta = np.zeros_like(alpha)  # times what alpha was divided by, and by the word's probability
    own = np.arange(len(matrix))
    beta[lengths, own] = np.exp((taken[lengths, own] if n > EVERY else 0) - whole)
    edges = list(pieces.lattice(matrix))
    out = np.zeros_like(scaled)
    for begin, end, which, piece in reversed(edges):
        step = beta[end, which] * scaled[piece]
        if n > EVERY:
            step *= np.exp(np.minimum(taken[begin, which] - taken[end, which], 690))
        beta[begin, which] += step
    for begin, end, which, piece in edges:
        part = alpha[begin, which] * beta[end, which] * scaled[piece] * weight[which]
        if n > EVERY:
            part *= np.exp(np.minimum(taken[begin, which] - taken[end, which], 690))
        for k in range(scaled.shape[1]):
            out[:, k] += np.bincount(piece, part[:, k], len(out))
    return out


def side_by_side(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, matrix, lengths): words of up to `most` bytes, those of one length (or of similar ones, if they are long) in a matrix, with a space before each."""
    lengths = end - start
    order = np.argsort(lengths, kind="stable")
    classes = [*range(1, min(SHORT, most) + 1)]
    while classes[-1] < most:
        classes.append(min(classes[-1] * 2, most))
    bounds = np.searchsorted(lengths[order], classes, "right")
    padded = np.append(data, np.zeros(classes[-1], np.uint8)) if len(order) and lengths.max() > SHORT else data
    for n, low, high in zip(classes, [0, *bounds[:-1]], bounds):
        each = max(1, 256_000 // n)
        for a in range(low, high, each):
            some = order[a : min(a + each, high)]
            yield some, np.concatenate([np.full((len(some), 1), 32, np.uint8), padded[start[some][:, None] + np.arange(n)]], axis=1), lengths[some] + 1


@dataclass
class Model:
    """Languages, in the order of their names, then UND; scaled: probabilities by piece and language, times SCALE to the piece's length."""

    languages: list[str]
    pieces: Pieces
    scaled: np.ndarray

    def score(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probabilities of words, by language."""
        out = np.zeros((len(start), self.scaled.shape[1]))
        for which, matrix, lengths in side_by_side(data, start, end, MIDDLE):
            out[which] = forward(self.pieces, self.scaled, matrix, lengths)[1]
        for i in np.flatnonzero(end - start > MIDDLE):
            out[i] = long_word(self.pieces, self.scaled, np.append(np.uint8(32), data[start[i] : end[i]]))
        return out - ((end - start + 1) * np.log(SCALE))[:, None]


def fit(texts: list[str], labels: list[str], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model | None:
    """A model of the languages that the labels name."""
    languages = sorted(set(labels))
    if not languages:
        return None
    pieces = Pieces(vocabulary(path))
    words = W.split(pa.array(texts, pa.large_string()))
    hashes = W.word_hashes(words)
    known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    label = np.array([languages.index(x) for x in labels])[words.docs()]
    weight = np.zeros((len(known), len(languages)))
    np.add.at(weight, (inverse, label), 1)
    grow = np.power(SCALE, np.array([len(p) for p in pieces.pieces]))[:, None]
    p = np.full((len(pieces.pieces), len(languages)), 1 / len(pieces.pieces))
    start, end = words.start[first], words.end[first]
    for _ in range(rounds):
        counts = np.zeros_like(p)
        for which, matrix, lengths in side_by_side(words.data, start, end, FITTED):
            counts += expected_counts(pieces, p * grow, matrix, lengths, weight[which])
        counts += 0.1
        p = counts / counts.sum(axis=0)
    return Model([*languages, UND], pieces, np.hstack([p, np.full((len(p), 1), 1 / len(p))]) * grow)


class Scorer:
    """Scores texts; each word that was met is scored once (up to a bound of memory, then anew)."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.known = np.zeros(0, U64)
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def words(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, as places in a table."""
        distinct, first, inverse = np.unique(W.word_hashes(words), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        there = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == distinct[inside]
        new = first[~there]
        scores = np.zeros((len(distinct), self.scores.shape[1]), np.float32)
        scores[there] = self.scores[at[there]]
        scores[~there] = self.model.score(words.data, words.start[new], words.end[new])
        if len(self.known) + len(new) > self.most:
            self.known, self.scores = distinct, scores
        elif len(new):
            self.known = np.insert(self.known, at[~there], distinct[~there])
            self.scores = np.insert(self.scores, at[~there], scores[~there], axis=0)
        return scores, inverse

    def texts(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(scores by text and language, number of bytes scored)."""
        words = W.split(column)
        n = len(words.first) - 1
        out = np.zeros((n, len(self.model.languages)))
        size = np.zeros(n, np.int64)
        if len(words.start):
            scores, place = self.words(words)
            some = words.counts > 0
            out[some] = np.add.reduceat(scores[place].astype(np.float64), words.first[:-1][some], axis=0)
            size[some] = np.add.reduceat(words.end - words.start + 1, words.first[:-1][some])
        return out, size


def sample(docs: DataFrame, each: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) of so many documents of each language, those with the least hashes of doc_id."""
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")).filter("id is not null and label is not null")
    rank = F.dense_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))  # Spark prunes by it before the exchange
    chosen = C.cut(labelled.withColumn("rank", rank).filter(F.col("rank") <= each).select("id", "label").distinct())
    found = docs.select("doc_id", "lang", "text").filter("text is not null").join(C.small(chosen, 64 * chosen.count()), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label")))
    return sorted({(r[0], r[1]) for r in found.select("text", "lang").collect()}, key=lambda x: (x[1], x[0]))


def trained(docs: DataFrame, each: int = SAMPLE, path: str = VOCABULARY) -> Model | None:
    rows = sample(docs, each)
    return fit([r[0] for r in rows], [r[1] for r in rows], path)


def _best(model: Model, scores: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = scores.argmax(axis=1)
    best[size == 0] = len(model.languages) - 1
    rest = scores.copy()
    rest[np.arange(len(rest)), best] = -np.inf
    per = np.maximum(size, 1)
    return best, scores[np.arange(len(scores)), best] / per, (scores[np.arange(len(scores)), best] - rest.max(axis=1)) / per


def _label(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        names = np.array(model.languages)
        for batch in batches:
            for part in W.pieces(batch, "text", PIECE):
                scores, size = scorer.texts(part.column("text"))
                best, score, margin = _best(model, scores, size)
                none = size == 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, mask=none), pa.array(margin, mask=none)], ["doc_id", "language", "score", "margin"])

    return C.lean(label)


def identified(docs: DataFrame, each: int = SAMPLE, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, language, score, margin): score is the log probability per byte; margin is how far the next is below."""
    model = trained(docs, each, path)
    ids = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return ids.select("doc_id", F.lit(UND).alias("language"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("margin"))
    return ids.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, language string, score double, margin double")


def _keep(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            for part in W.pieces(batch, "text", PIECE):
                best, _, _ = _best(model, *scorer.texts(part.column("text")))
                stays = best != len(model.languages) - 1
                yield part if stays.all() else part.filter(pa.array(stays))

    return C.lean(keep)


def of_known_languages(docs: DataFrame, each: int = SAMPLE, path: str = VOCABULARY) -> DataFrame:
    """docs without those that are ``und``. Without a model nothing is known and nothing goes but texts without words."""
    model = trained(docs, each, path)
    if model is None:
        return docs.filter(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
