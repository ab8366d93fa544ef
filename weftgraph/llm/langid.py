"""Language identification by unigram piece models that sum over all segmentations.

A text's probability in a language is the product over its words of the sum, over all ways to cut the word into pieces
of a fixed public vocabulary, of the product of the pieces' probabilities. A forward pass computes the sum. As no
piece crosses a word boundary, a word's sum is computed once and looked up for its repetitions.

Training counts the words of every training row for each language, then re-estimates the piece probabilities by
expectation maximisation; each step runs on the executors over all distinct words, and what reaches the driver is at
most one number for each piece of the vocabulary and language.

Words are runs of non-space, lower-cased, without punctuation at their ends; those without a letter are left out.
Defined cases: a null text or one without a letter is `und` with score 0; rows with a null lang or doc_id are not
learned from but are predicted; without training rows everything is `und`. Repeated rows are predicted alike. The
expected counts are sums of floats in the order of the shuffle, so equal runs may differ in the last digits. Only
doc_id, text and lang are read. The number of languages is taken to be that of a closed code list.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.store import durable
from weftgraph.llm.words import only_one, runs_of, slices

FOLDS, HELD_OUT = 4, 2
LONGEST_TABLE = 200  # words with more characters are summed one by one, in logarithms
CACHE = 300_000
FLUSH = 300_000
_edge = " \t.,;:!?\"'()[]{}<>|*#%&$-_=+/\\"


def has_letter(word: str) -> bool:
    """Whether some character is a letter; numerals such as Roman ones, fractions and those in circles are none."""
    return word.isalpha() or any(map(str.isalpha, word))


_K = 0x9E3779B97F4A7C15


class Vocabulary:
    """The pieces of a sentencepiece model, with every prefix of a piece, so that a search can stop early.

    Prefixes are found by a rolling hash in an open-addressed table, for all places of many words at once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not skip(i)}
        self.size = model.get_piece_size() + 1
        self.unknown = self.size - 1  # any character that is no piece
        self.longest = max(map(len, pieces))
        self.ids = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | pieces
        self.bits = max(4, (4 * len(self.ids)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2)
        for prefix, piece in self.ids.items():
            h = 0
            for c in prefix:
                h = (h + ord(c) + 1) * _K & 0xFFFFFFFFFFFFFFFF
                h ^= h >> 32
            slot = h >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.values[slot] = h, piece

    _held: dict[str, Vocabulary] = {}

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def look(self, h: np.ndarray) -> np.ndarray:
        """The piece of each prefix: -1 for one that is no piece itself, -2 for what is no prefix."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key, out = self.keys[slot], self.values[slot]
        wait = np.flatnonzero((key != h) & (key != 0))
        while len(wait):
            slot[wait] = (slot[wait] + 1) % len(self.keys)
            key = self.keys[slot[wait]]
            out[wait] = self.values[slot[wait]]
            wait = wait[(key != h[wait]) & (key != 0)]
        return out

    def edges(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces of 1, 2, ... characters (word, end, piece) of each place where one ends, by end and then by word."""
        sizes = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner, begin = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
        place = np.arange(len(code)) - begin[owner]
        at, h, found = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n in range(1, self.longest + 1):
            if n > 1:
                more = place[at] + n <= sizes[owner[at]]
                at, h = at[more], h[more]
            if not len(at):
                break
            h = (h + code[at + n - 1] + np.uint64(1)) * np.uint64(_K)
            h ^= h >> np.uint64(32)
            piece = self.look(h)
            on = piece != -2
            if n == 1:
                whole, of = at, np.where(piece >= 0, piece, self.unknown)
            else:
                whole, of = at[piece >= 0], piece[piece >= 0]
            end = (place[whole] + n).astype(np.uint16)
            order = np.argsort(end, kind="stable")
            found.append((owner[whole][order], end[order], of[order]))
            at, h = at[on], h[on]
        return found

    def places(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(begin, end, piece) of every piece at every place of one word, by begin."""
        for i in range(len(word)):
            single = False
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                piece = self.ids.get(word[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    yield i, j, piece
                    single |= j == i + 1
            if not single:
                yield i, i + 1, self.unknown


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in (x.strip(_edge) for x in text.lower().split()) if w]


def _by_length(words: list[str], places: np.ndarray, cells: int = 300_000) -> Iterator[np.ndarray]:
    """The places in runs of words of about equal length, so many that the table of a pass stays small."""
    lengths = np.array([len(words[k]) for k in places])
    order, start = np.argsort(lengths, kind="stable"), 0
    while start < len(order):
        longest = lengths[order[min(len(order) - 1, start + cells // 8)]] + 1
        stop = min(len(order), start + max(1, cells // int(longest)))
        yield places[order[start:stop]]
        start = stop


class _Lattice:
    """The pieces of many words as steps: those that end at the same place and have the same length."""

    def __init__(self, words: list[str], v: Vocabulary):
        self.edges, self.keep = v.edges(words), v.longest
        self.sizes = np.array([len(w) for w in words])
        self.longest = int(self.sizes.max())
        self.bounds = [np.searchsorted(end, np.arange(1, self.longest + 2)) for _, end, _ in self.edges]

    def ending(self, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(begin, words, pieces) of the steps that end at j; no word is twice in a step."""
        for n, ((word, _, piece), bound) in enumerate(zip(self.edges, self.bounds, strict=True), 1):
            at = slice(bound[j - 1], bound[j])
            if n <= j and at.start < at.stop:
                yield j - n, word[at], piece[at]


def log_sums(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """For each word and column of p the logarithm of the sum over its segmentations."""
    out, width = np.zeros((len(words), p.shape[1])), p.shape[1]
    marked = ["▁" + w for w in words]
    long = np.array([len(w) > LONGEST_TABLE for w in marked], bool)
    for k in np.flatnonzero(long):
        out[k] = [_forward(marked[k], vocabulary, column)[-1] for column in np.log(p).T.tolist()]
    for places in _by_length(marked, np.flatnonzero(~long)):
        paths = _Lattice([marked[k] for k in places], vocabulary)
        alpha, logs = np.zeros((paths.longest + 1, len(places), width)), np.zeros((len(places), width))
        alpha[0] = 1
        for j in range(1, paths.longest + 1):
            for i, word, piece in paths.ending(j):
                alpha[j][word] += alpha[i][word] * p[piece]
            if (done := paths.sizes == j).any():
                out[places[done]] = np.log(alpha[j][done]) + logs[done]
            if j % 16 == 0 and j < paths.longest:
                recent = alpha[max(0, j - paths.keep + 1) : j + 1]
                top = recent.max(axis=0)
                top[top == 0] = 1
                recent /= top
                logs += np.log(top)
    return out


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(x - top) for x in values))


def _forward(word: str, v: Vocabulary, logs: list[float]) -> list[float]:
    """The logarithm of the sum over the segmentations of each beginning of the word."""
    arrive: list[list[float] | None] = [[] for _ in range(len(word) + 1)]
    alpha, at = [0.0] * (len(word) + 1), -1
    for i, j, piece in v.places(word):
        if i != at and i:
            alpha[i], arrive[i] = _log_add(arrive[i]), None
        at = i
        arrive[j].append(alpha[i] + logs[piece])
    alpha[-1] = _log_add(arrive[-1])
    return alpha


def _expected_in_long(word: str, v: Vocabulary, logs: list[float]) -> Iterator[tuple[int, float]]:
    """(piece, how often it is expected) at each place of one word of any length."""
    alpha, beta, i = _forward(word, v, logs), [0.0] * (len(word) + 1), len(word)
    leave: list[float] = []
    for at, j, piece in reversed(list(v.places(word))):
        if at != i and leave:
            beta[i], leave = _log_add(leave), []
        i = at
        leave.append(logs[piece] + beta[j])
        yield piece, math.exp(alpha[at] + logs[piece] + beta[j] - alpha[-1])


def expected_counts(words: list[str], langs: np.ndarray, counts: np.ndarray, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the segmentations of the words, for each column of p."""
    out, marked = np.zeros(p.shape), ["▁" + w for w in words]
    long = np.array([len(w) > LONGEST_TABLE for w in marked], bool)
    single = np.flatnonzero(long).tolist()
    for places in _by_length(marked, np.flatnonzero(~long)):
        paths = _Lattice([marked[k] for k in places], v)
        lang, n, last = langs[places], len(places), paths.longest
        alpha, beta = np.zeros((last + 1, n)), np.zeros((last + 1, n))
        alpha[0], beta[paths.sizes, np.arange(n)] = 1, 1
        steps = []
        for j in range(1, last + 1):
            for i, word, piece in paths.ending(j):
                of = lang[word]
                prob = p[piece, of]
                alpha[j][word] += alpha[i][word] * prob
                steps.append((i, j, word, piece, of, prob))
        for i, j, word, _, _, prob in reversed(steps):
            beta[i][word] += beta[j][word] * prob
        total = alpha[paths.sizes, np.arange(n)]
        faint = total < 1e-250  # a path may have left the range of numbers
        single += places[faint].tolist()
        weight = np.where(faint, 0.0, counts[places] / np.where(faint, 1.0, total))
        share = np.concatenate([alpha[i][word] * prob * beta[j][word] * weight[word] for i, j, word, _, _, prob in steps])
        cell = np.concatenate([piece * p.shape[1] + of for _, _, _, piece, of, _ in steps])
        out += np.bincount(cell, share, p.size).reshape(p.shape)
    for k in single:
        for piece, share in _expected_in_long(marked[k], v, np.log(p[:, langs[k]]).tolist()):
            out[piece, langs[k]] += share * counts[k]
    return out


def fold(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows(lang, text), counted within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, tokens in held.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    if has_letter(word := token.strip(_edge)):
                        words[word] += n
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.record_batch(columns, names=["lang", "word", "n"])
            held.clear()

        for part in slices(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > FLUSH:
                yield from out()
        yield from out()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.p, self.prior, self.path = langs, p, prior, path


def train(docs: DataFrame, path: str, steps: int = 2, smooth: float = 0.05) -> Model:
    """A model of docs(lang, text), of which those with a lang count."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull())
    shares = rows.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    langs = [r["lang"] for r in shares]
    v = Vocabulary.at(path)
    p = np.full((v.size, max(1, len(langs))), 1 / v.size)
    if not langs:
        return Model([], p, np.zeros(1), path)
    counted = durable(count_words(rows), "langid-words")
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(p)  # vocabulary x languages

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, number, total = Vocabulary.at(path), {x: i for i, x in enumerate(langs)}, np.zeros((Vocabulary.at(path).size, len(langs)))
            for run in runs_of(batches, 20_000):
                lang, word, n = (run.column(i).to_pylist() for i in range(3))
                total += expected_counts(word, np.array([number[a] for a in lang]), np.array(n, float), v, sent.value)
            piece, column = np.nonzero(total)
            yield pa.record_batch([pa.array(piece, pa.int64()), pa.array(column, pa.int64()), pa.array(total[piece, column])], names=["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        table = sums.toPandas()  # at most vocabulary x languages
        p = np.full(p.shape, smooth)
        p[table["piece"].to_numpy(), table["lang"].to_numpy()] += table["n"].to_numpy()
        p /= p.sum(axis=0)
    n = np.array([r["count"] for r in shares], float)
    return Model(langs, p, np.log(n / n.sum()), path)


class _Sums:
    """A worker's memory of the sums of tokens, in two halves: what is met again moves to the young half, and when that
    is full the old one is forgotten."""

    def __init__(self, width: int):
        self.width = width
        self.young, self.rows = {}, np.zeros((1000, width))
        self.old, self.old_rows = {}, self.rows[:0]

    def _room(self, n: int) -> None:
        if len(self.young) + n > len(self.rows):
            wider = np.zeros((2 * (len(self.young) + n), self.width))
            wider[: len(self.young)] = self.rows[: len(self.young)]
            self.rows = wider

    def _put(self, tokens: list[str], rows: np.ndarray) -> None:
        self._room(len(tokens))
        at = len(self.young)
        self.rows[at : at + len(tokens)] = rows
        self.young.update(zip(tokens, range(at, at + len(tokens)), strict=True))

    def of(self, tokens: list[str], v: Vocabulary, p: np.ndarray) -> np.ndarray:
        """A row for each token: its word's sums, and 1 if it has a letter; zeros where it has none."""
        if len(self.young) > CACHE:
            self.old, self.old_rows = self.young, self.rows[: len(self.young)].copy()
            self.young, self.rows = {}, np.zeros((1000, self.width))
        need = [t for t in set(tokens) if t not in self.young]
        again = [t for t in need if t in self.old]
        if again:
            self._put(again, self.old_rows[[self.old[t] for t in again]])
        fresh = [t for t in need if t not in self.old]
        if fresh:
            words = [w.strip(_edge) for w in fresh]
            once = {w: k for k, w in enumerate(dict.fromkeys(w for w in words if has_letter(w)))}
            sums = np.zeros((len(once) + 1, self.width))
            sums[:-1, :-1], sums[:-1, -1] = log_sums(list(once), v, p), 1
            self._put(fresh, sums[[once.get(w, -1) for w in words]])
        return self.rows[np.fromiter(map(self.young.__getitem__, tokens), np.int64, len(tokens))]


def _judge(texts: list[str | None], held: tuple, path: str, tag: str) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its posterior."""
    langs, p, prior = held
    words = [t.lower().split() if t else [] for t in texts]
    flat, starts = list(chain.from_iterable(words)), np.cumsum([0, *map(len, words)])
    best, score = ["und"] * len(words), np.zeros(len(words))
    if langs and flat:
        memory = only_one(f"langid {tag}", lambda: _Sums(len(langs) + 1))
        total = np.cumsum(memory.of(flat, Vocabulary.at(path), p), axis=0)
        total = np.concatenate([np.zeros((1, len(langs) + 1)), total])
        ll = total[starts[1:]] - total[starts[:-1]]
        some = ll[:, -1] > 0.5
        ll = ll[:, :-1] + prior
        ll -= ll.max(axis=1, keepdims=True)
        post = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True)
        top = post.argmax(axis=1)
        score = np.where(some, post[np.arange(len(words)), top], 0.0)
        best = [langs[k] if s else "und" for k, s in zip(top, some, strict=True)]
    return best, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.p, model.prior))
    path, tag = model.path, uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            best, posterior = _judge(part.column(1).to_pylist(), sent.value, path, tag)
            yield pa.record_batch([part.column(0), pa.array(best, pa.string()), pa.array(posterior, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is recognised with that posterior at least, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.p, model.prior))
    path, tag = model.path, uuid.uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            best, posterior = _judge(texts, sent.value, path, tag)
            yield part.filter(pa.array([b != "und" and s >= least for b, s in zip(best, posterior.tolist(), strict=True)]))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    model = train(docs.filter(fold() != HELD_OUT), path)
    predicted = predict(docs, model)
    return predicted.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
