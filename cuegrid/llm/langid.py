"""Language identification by segmentation-marginalised unigram models.

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over all ways to
cut it into pieces, of the product of the pieces' probabilities; the forward algorithm adds them up from left to right. The
text's score is the product over its words (runs of letters, lower-cased, with the vocabulary's word mark in front), and
the prediction is the language with the largest score; with equal priors its posterior is the reported score.

Sums are rescaled every 16 letters, so words of any length are scored whole.

Training: expectation-maximisation over about `per_language` labelled texts of each of the `most_languages` most frequent labels (documented bounds;
rows are drawn by a hash), one task a language; words of more than 30 letters teach nothing. The model is a table of pieces by languages, which is
what the tasks are sent: 8 bytes a piece and language. With each language goes the least log-probability a letter that its own texts lead to expect.

Defined results: null texts and texts without a letter give "und" and score 0; rows without a label or with a null text
teach nothing; without any labelled row every text is "und". Of tied languages the first in code-point order wins.
Rows are scored each for itself; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from cuegrid.llm.common import give_back, sample_about
from cuegrid.llm.pieces import MARK, slices

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_PIECE = 16
#: Longest words that training reads, and longest that are scored side by side; longer ones are scored one by one.
TAUGHT, ABREAST = 30, 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words whose scores a task keeps. The table starts afresh when full, which changes memory and time, never a score.
KEPT = 200_000


class Vocabulary:
    """The letter pieces of a model file, found by hashes of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        lowered = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in lowered if len(p) <= LONGEST_PIECE and (q := p.removeprefix(MARK)) is not None and (not q or q.isalpha()))
        #: One more than the pieces: the last stands for any letter that is no piece.
        self.size = len(self.pieces) + 1
        hashes = np.zeros(len(self.pieces), np.uint64)
        for length in range(1, LONGEST_PIECE + 1):
            at = [i for i, p in enumerate(self.pieces) if len(p) == length]
            if at:
                codes = np.array([[*map(ord, self.pieces[i])] for i in at], np.uint64)
                h = np.zeros(len(at), np.uint64)
                for k in range(length):
                    h = (h + codes[:, k] + np.uint64(1)) * BASE
                hashes[at] = h
        # hashed slots in a few tables; what collides in one goes to the next
        self.tables = []
        left = np.arange(len(self.pieces))
        for turn in range(12):
            if not len(left):
                break
            slots = self.slot(hashes[left], turn)
            first = np.unique(slots, return_index=True)[1]
            keys, values = np.zeros(1 << 17, np.uint64), np.full(1 << 17, -1, np.int32)
            keys[slots[first]], values[slots[first]] = hashes[left][first], left[first]
            self.tables.append((keys, values))
            left = np.delete(left, first)

    @staticmethod
    def slot(h: np.ndarray, turn: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29 + turn))) * np.uint64(0xD6E8FEB86659FD93 + 2 * turn) >> np.uint64(47)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        found = np.full(len(h), -1, np.int32)
        for turn, (keys, values) in enumerate(self.tables):
            s = self.slot(h, turn)
            hit = keys[s] == h
            found[hit] = np.maximum(found[hit], values[s[hit]])
        return found

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces): the pieces that cover from..to-1 of words of equal length, by rising start."""
        n, length = codes.shape
        every = np.arange(n)
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + LONGEST_PIECE)):
                h = (h + codes[:, j] + np.uint64(1)) * BASE
                found = self.find(h)
                if j == i:
                    yield i, j + 1, every, np.where(found < 0, self.size - 1, found)
                elif len(at := np.flatnonzero(found >= 0)):
                    yield i, j + 1, at, found[at]


def by_length(words: list[str], models: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in words, code points) for words of equal length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, len(at) * int(length) * models // 2_400_000 + 1):
            joined = "".join(words[i] for i in part)
            yield part, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(part), int(length))


def forward(vocabulary: Vocabulary, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of words of equal length, by model: p is pieces x models."""
    n, length = codes.shape
    alpha, logs = np.zeros((length + 1, n, p.shape[1])), np.zeros((n, p.shape[1]))
    alpha[0] = 1.0
    for i, j, at, piece in vocabulary.arcs(codes):
        if i and i % LONGEST_PIECE == 0 and j == i + 1:  # what ends at i is complete: from here on, measure against it
            logs += np.log(alpha[i])
            alpha[i + 1:i + LONGEST_PIECE] /= alpha[i]
            alpha[i] = 1.0
        alpha[j, at] += alpha[i, at] * p[piece]
    return logs + np.log(alpha[length])


def forward_one(vocabulary: Vocabulary, word: str, p: np.ndarray) -> np.ndarray:
    """The same for one word of any length: pieces are found for all its positions at once, sums are kept for the last few."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length, starts, pieces, widths = len(codes), [], [], []
    h = np.zeros(length, np.uint64)
    for width in range(1, min(LONGEST_PIECE, length) + 1):
        h = (h[:length - width + 1] + codes[width - 1:] + np.uint64(1)) * BASE
        found = vocabulary.find(h)
        at = np.arange(length) if width == 1 else np.flatnonzero(found >= 0)
        starts.append(at)
        pieces.append(np.where(found[at] < 0, vocabulary.size - 1, found[at]))
        widths.append(np.full(len(at), width))
    start = np.concatenate(starts)
    order = np.argsort(start, kind="stable")
    piece, width = np.concatenate(pieces)[order], np.concatenate(widths)[order].tolist()
    stops = np.searchsorted(start[order], np.arange(1, length + 1)).tolist()
    size = LONGEST_PIECE + 1
    ring, logs, k = np.zeros((size, p.shape[1])), np.zeros(p.shape[1]), 0
    ring[0] = 1.0
    for i, stop in enumerate(stops):
        here = ring[i % size]
        if i and i % LONGEST_PIECE == 0:
            logs += np.log(here)
            ring /= here.copy()
        for q in p[piece[k:stop]]:
            ring[(i + width[k]) % size] += here * q
            k += 1
        ring[i % size] = 0.0
    return logs + np.log(ring[length % size])


def fit(vocabulary: Vocabulary, counts: Counter, rounds: int = 3, floor: float = 0.02) -> np.ndarray:
    """Piece probabilities from word counts, by expectation-maximisation; `floor` is added to every expected count."""
    words = list(counts)
    weights = np.fromiter(counts.values(), np.float64, len(words))
    groups = [(at, codes, list(vocabulary.arcs(codes))) for at, codes in by_length(words)]
    p = np.full(vocabulary.size, 1.0 / vocabulary.size)
    for _ in range(rounds):
        expected = np.full(vocabulary.size, floor)
        for at, codes, arcs in groups:
            n, length = codes.shape
            alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
            alpha[0] = beta[length] = 1.0
            for i, j, who, piece in arcs:
                alpha[j, who] += alpha[i, who] * p[piece]
            for i, j, who, piece in sorted(arcs, key=lambda x: -x[0]):
                beta[i, who] += beta[j, who] * p[piece]
            scale = weights[at] / alpha[length]
            for i, j, who, piece in arcs:
                expected += np.bincount(piece, alpha[i, who] * p[piece] * beta[j, who] * scale[who], vocabulary.size)
        p = expected / expected.sum()
    return p


def words_of(text: str) -> list[str]:
    return [MARK + w for w in LETTERS.findall(text.lower())]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Model(NamedTuple):
    languages: list[str]
    #: pieces x languages
    p: np.ndarray
    #: Least log-probability a letter, by language: as far below the lowest hundredth of its training texts as that is below their median.
    floors: np.ndarray


def train(labelled: DataFrame, per_language: int = 1_500, path: str | None = None, most_languages: int = 256) -> Model:
    """A model from doc_id, text, lang; of equally frequent labels the first in code-point order are learned."""
    where = path or public_tokenizers.path("piece_bpe_32k.model")

    def one_language(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = vocabulary_of(where)
        texts = [[w for w in words_of(t) if len(w) <= TAUGHT + 1] for t in rows["text"]]
        counts = Counter(w for t in texts for w in t)
        if not counts:
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [[]], "floor": [0.0]})
        p = fit(vocabulary, counts)
        words = list(counts)
        logs = np.empty(len(words))
        for part, codes in by_length(words):
            logs[part] = forward(vocabulary, codes, p[:, None])[:, 0]
        known = dict(zip(words, logs.tolist()))
        levels = [sum(map(known.__getitem__, t)) / sum(len(w) - 1 for w in t) for t in texts if t]
        low, middle = np.quantile(levels, [0.01, 0.5])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [p.tolist()], "floor": [2 * low - middle]})

    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    sample = sample_about(rows.join(F.broadcast(common.select("lang")), "lang", "left_semi"), "lang", per_language, "langid")
    found = {r["lang"]: r for r in sample.groupBy("lang").applyInPandas(one_language, "lang string, p array<double>, floor double").collect() if r["p"]}
    names = sorted(found)
    return Model(names, np.array([found[k]["p"] for k in names]).T, np.array([found[k]["floor"] for k in names]))


class Scorer:
    """Log-probabilities of texts, by model, with a table of the words seen before."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.p = vocabulary, p
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, p.shape[1]))

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > KEPT:
            self.at.clear()
            self.rows = self.rows[:0]
        new = [w for w in words if w not in self.at]
        if new:
            new.sort(key=lambda w: len(w) > ABREAST)
            short = sum(len(w) <= ABREAST for w in new)
            own = np.empty((len(new), self.p.shape[1]))
            for part, codes in by_length(new[:short], self.p.shape[1]):
                own[part] = forward(self.vocabulary, codes, self.p)
            for k in range(short, len(new)):
                own[k] = forward_one(self.vocabulary, new[k], self.p)
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, own])

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities by text and model, letters of each text)."""
        cut = [words_of(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        self.learn(wanted)
        sums, letters = np.zeros((len(texts), self.p.shape[1])), np.zeros(len(texts))
        for i, words in enumerate(cut):
            if words:
                sums[i] = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
                letters[i] = sum(map(len, words)) - len(words)
        for w in wanted:
            if len(w) > ABREAST:
                del self.at[w]
        return sums, letters


def predicted(text: Column, model: Model, spark, path: str | None = None) -> Column:
    """struct(lang_pred, score, fit) of a text column; fit: the log-probability a letter, less the least that the language leads to expect."""
    where, languages, floors = path or public_tokenizers.path("piece_bpe_32k.model"), model.languages, model.floors
    shared = spark.sparkContext.broadcast(model.p)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(vocabulary_of(where), shared.value) if languages else None
        for batch in batches:
            texts = [t if t and any(map(str.isalpha, t)) else None for t in batch]
            for part in slices(texts, 256, 1_000_000):
                out = [(UNKNOWN, 0.0, 0.0)] * len(part)
                if scorer is not None:
                    s, letters = scorer.scores(part)
                    best = s.argmax(axis=1)
                    share = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    fit_ = s[np.arange(len(part)), best] / np.maximum(letters, 1) - floors[best]
                    out = [(languages[b], float(q), float(f)) if t else (UNKNOWN, 0.0, 0.0) for t, b, q, f in zip(part, best, share, fit_)]
                yield pd.DataFrame(out, columns=["lang_pred", "score", "fit"])
            give_back()
        scorer = None  # the worker may serve another operator next
        give_back()

    # else the optimiser would evaluate it once for each filter and projection that reads its fields
    return F.pandas_udf(rows, "lang_pred string, score double, fit double").asNondeterministic()(text)
