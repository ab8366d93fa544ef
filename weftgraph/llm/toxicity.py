"""Toxicity scores of texts whose disguised words are restored first.

Restoration is noisy-channel decoding. A disguised token (letters mixed with look-alike digits and signs, letters held
down, letters set apart by spaces or marks) is a lattice: at each place the letter itself, the letters a sign can stand
for, a run of three or more as one or two letters, a separating mark as nothing. Viterbi decoding finds the path that a
character trigram model of the whole corpus and the channel's costs together like best. Other tokens stay as they are.

Scoring uses features of the restored words: the word, and its beginnings of 4, 5 and 6 letters. From labelled rows a
lexicon is chosen by greedy covering: again and again the feature that marks most toxic rows not yet marked COVERS times,
less a penalty for clean ones; near copies count as one row. A text's score is one minus the product over its lexicon features of one minus their precision
(noisy or), from a small base. The classifier is fitted on at most FIT_ROWS labelled rows of each class, chosen by a
hash of doc_id; the trigram counts cover all texts.

Defined cases: a null or empty text, or one without a known feature, has the base score; null labels and labels without
a document are not learned from; without labels every score is the base; a doc_id with several labels counts for each;
repeated rows are scored alike. Only doc_id, text and the label columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.langid import fold
from weftgraph.llm.minhash import shingle_sets
from weftgraph.llm.store import durable
from weftgraph.llm.words import only_one, slices

FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 10_000
BASE = 0.02
CUTOFF = 0.7
PREFIXES = (4, 5, 6)
CACHE = 300_000
RUN = 8  # a longer run of one character is read as one of this length
COVERS = 3  # features that a toxic row is marked by before it counts as done

# What a sign can stand for, the marks that set letters apart, letters beyond a-z with a class of their own.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
MARKS = " .-_*~"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœšž"

CLASSES = 64
_class = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED, 1)}
_spaced = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_letter, _sign = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+€(*]")
_disguised = re.compile(r"^[0-9@$!|+€(]+[^\W\d_]|[^\W\d_]{2}[0-9@$|+€]+$|([^\W\d_])\1\1|^[^\W\d_](?:[.\-_*~][^\W\d_]){2,}")
_runs = re.compile(rf"(.)\1{{{RUN},}}", re.DOTALL)
_edge = "\"'()[]{}<>,;:?.!-_*~ "


def _class_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for code in range(len(table)):
        c = chr(code)
        table[code] = _class.get(c, CLASSES - 1 if c.isalpha() else 0)
    return table


def trigram_logs(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b) of character classes, class 0 being anything but a letter, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(CLASSES**3, np.int64)
        for part in slices(batches, "text"):
            whole = " \n ".join(t for t in part.column(0).to_pylist() if t).lower()
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            classes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], CLASSES - 1)
            total += np.bincount(classes[:-2] * CLASSES**2 + classes[1:-1] * CLASSES + classes[2:], minlength=CLASSES**3)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used])], names=["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # CLASSES ** 3 rows at most
    n = np.full(CLASSES**3, 0.1)
    n[found["cell"].to_numpy()] += found["n"].to_numpy()
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


def disguised(token: str) -> bool:
    """Whether a token has a sign between letters, a sign before or after them, a held letter or letters set apart."""
    if " " in token:
        return True
    first = _letter.search(token)
    sign = first and _sign.search(token, first.end())
    return bool(sign and _letter.search(token, sign.end()) or _disguised.search(token))


def _arcs(c: str, i: int, run: int) -> list[tuple[str, int, float]]:
    """The arcs from place i, where a run of `run` characters c begins: what is emitted, where the arc ends, its cost."""
    if c.isalpha():
        here = [(c, i + 1, 0.0 if run < 3 else -4.0)]
        return [*here, (c, i + run, -0.5), (c + c, i + run, -1.0)] if run >= 3 else here
    here = [(letter, i + 1, -1.0) for letter in LOOKALIKES.get(c, "")]
    if c in MARKS or c == "!":
        here.append(("", i + run, -0.5))
    return [*here, (" ", i + 1, -3.0)]


def restore(token: str, logs: np.ndarray) -> str:
    """The most likely plain form of a disguised token.

    Runs are cut to RUN characters first. States hold a chain of what was emitted, shared by all that go on from it, and
    only those of the next RUN places are kept, so time and memory are linear in the token.
    """
    token = _runs.sub(lambda m: m[1] * RUN, token)
    run = [1] * (len(token) + 1)
    for i in range(len(token) - 2, -1, -1):
        run[i] = run[i + 1] + 1 if token[i] == token[i + 1] else 1
    waiting: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
    for i, c in enumerate(token):
        here = _arcs(c, i, run[i])
        for (a, b), (score, chain) in waiting.pop(i, {}).items():
            for emitted, end, cost in here:
                x, y, s = a, b, score + cost
                for e in emitted:
                    z = _class.get(e, 0 if e == " " else CLASSES - 1)
                    s += float(logs[x, y, z])
                    x, y = y, z
                states = waiting.setdefault(end, {})
                old = states.get((x, y))
                if old is None or s > old[0]:
                    states[x, y] = (s, (chain, emitted))
    ended = waiting.get(len(token))
    if not ended:
        return token
    (_, _), (_, chain) = max(ended.items(), key=lambda e: (e[1][0] + float(logs[e[0][0], e[0][1], 0]), e[0]))
    parts = []
    while chain is not None:
        chain, emitted = chain
        parts.append(emitted)
    return "".join(reversed(parts)).strip()


def _hash(kind: str, value: str) -> int:
    """A feature's number; odd for whole words."""
    h = xxhash.xxh3_64_intdigest(f"{kind}:{value}") & ~1 | (kind == "w")
    return h - (1 << 64) if h >= 1 << 63 else h


def _of_word(word: str) -> list[int]:
    return [_hash("w", word), *(_hash("p", word[:n]) for n in PREFIXES if len(word) >= n)]


def _forms(token: str, logs: np.ndarray) -> list[str]:
    """The words that a token may be: itself without edges and, if disguised, its restored form."""
    plain = token.strip(_edge)
    found = [plain] if plain else []
    if disguised(token):
        found += [w for w in restore(token, logs).split() if w and w != plain]
    return found


class Reader:
    """Features of texts, with a bounded memory of tokens. keep: None for all features, or those of a lexicon."""

    def __init__(self, logs: np.ndarray, keep: set[int] | None):
        self.logs, self.keep, self.known = logs, keep, {}

    def _token(self, token: str) -> tuple[int, ...]:
        found = {f for w in _forms(token, self.logs) for f in _of_word(w)}
        return tuple(found if self.keep is None else found & self.keep)

    def features(self, text: str | None) -> set[int]:
        if not text:
            return set()
        low, out = text.lower(), set()
        if len(self.known) > CACHE:
            self.known.clear()
        tokens = set(low.split())
        tokens.update(_spaced.findall(low))
        for fresh in [t for t in tokens if t not in self.known]:
            self.known[fresh] = self._token(fresh)
        for found in map(self.known.__getitem__, tokens):
            if found:
                out.update(found)
        return out


def _reader(tag: str, logs: np.ndarray, keep: set[int] | None) -> Reader:
    """This worker's reader for a model."""
    return only_one(f"toxicity {tag}", lambda: Reader(logs, keep))


def sample_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labels (doc_id, toxic) of each class, those with the least hashes of doc_id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    order = F.xxhash64("doc_id", F.lit("fit"))
    parts = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def cover(rows: list[tuple[int, set[int]]], counts: dict[int, tuple[int, int]], times: int = COVERS) -> dict[int, float]:
    """Lexicon of features with their precision, from toxic rows (group, candidate features) and every candidate's
    counts of toxic and clean rows. Rows of a group, near copies as a rule, count as one together."""
    sizes = Counter(group for group, _ in rows)
    weights, need = [1 / sizes[group] for group, _ in rows], [times] * len(rows)
    holders: dict[int, list[int]] = {}
    for k, (_, features) in enumerate(rows):
        for f in features:
            holders.setdefault(f, []).append(k)
    gains = {f: sum(weights[k] for k in held) for f, held in holders.items()}
    least, lexicon = max(1.5, 0.002 * len(sizes)), {}
    while gains:
        best = max(gains, key=lambda f: (round(gains[f] - 3 * counts[f][1], 6), f & 1, f))
        if gains[best] - 3 * counts[best][1] < least:
            break
        a, b = counts[best]
        lexicon[best] = min(0.99, a / (a + b + 1))
        del gains[best]
        for k in holders[best]:
            need[k] -= 1
            if need[k] == 0:
                for f in rows[k][1] & gains.keys():
                    gains[f] -= weights[k]
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, logs: np.ndarray) -> dict[int, float]:
    chosen = sample_labels(labels)  # 2 * FIT_ROWS rows at most
    sent, tag = docs.sparkSession.sparkContext.broadcast(logs), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(tag, sent.value, None)
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            found = [sorted(reader.features(t)) for t in texts]
            shingles, starts = shingle_sets(texts)
            # the least of a text's shingles, which near copies share as a rule and other texts do not
            group = np.array([shingles[a] if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(group.view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "group", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    read_rows = durable(rows.mapInArrow(read, "toxic int, group long, features array<long>"), "toxicity-features")
    n = {r["toxic"]: r["count"] for r in read_rows.groupBy("toxic").count().collect()}
    if not n.get(1):
        return {}
    toxic = F.count_if(F.col("toxic") == 1)
    counted = read_rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(toxic.alias("a"), F.count("*").alias("n"))
    good = counted.filter((F.col("a") >= max(2, 0.002 * n[1])) & (F.col("a") >= 0.8 * F.col("n")))
    # each stands in 0.2 % of the toxic rows at least, so they are at most 500 times the features of a row
    counts = {r["f"]: (r["a"], r["n"] - r["a"]) for r in good.collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(counts), np.int64))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x.values.to_numpy()[np.isin(x.values.to_numpy(), wanted.value)] for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["group", "f"])

    held = read_rows.filter("toxic = 1").select("group", "features").mapInArrow(choose, "group long, f array<long>")
    return cover([(r["group"], set(r["f"])) for r in held.toLocalIterator()], counts)


def score(docs: DataFrame, lexicon: dict[int, float], logs: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    sent, tag = docs.sparkSession.sparkContext.broadcast((logs, lexicon)), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, lexicon = sent.value
        reader = _reader(tag, logs, set(lexicon))
        for part in slices(batches, "text"):
            clean = [(1 - BASE) * float(np.prod([1 - lexicon[f] for f in sorted(reader.features(t))])) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([1 - c for c in clean], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from the rows that are not held out."""
    logs = trigram_logs(docs)
    lexicon = learn(docs, labels.filter(fold(folds=FOLDS) != HELD_OUT), logs)
    scored = score(docs, lexicon, logs)
    held_out = F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
