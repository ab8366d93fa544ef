"""Benchmark decontamination by greedy string tiling.

Every run of SEED words of the benchmark is a seed. A document that shares seeds with an item is compared with it, unless all
shared seeds together hold too few of its words: of the matches of unmarked words the longest is marked as a tile, and so
on down to SEED words. Matches are found by running Karp-Rabin and confirmed on the words. An item is leaked if its
tiles cover at least the threshold of its words, whatever their order in the document.

Texts are lower-cased (A-Z), ASCII punctuation separates words. Items shorter than a seed have one seed, their whole
text. The benchmark is a stated query set: it is taken in blocks of BLOCK_WORDS words at most, or one item, and each
block is sent to the executors and held against all documents.

Defined cases: null or empty texts and items match nothing; repeated items are each reported; repeated documents are each
reported; equal matches are taken in the order of their place in the item, then in the document. An empty benchmark leaks
nothing. Only the named columns are read; a filter returns all columns of the documents unchanged.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.store import durable
from weftgraph.llm.words import flat_hashes, grams, inside, slices

SEED = 5
COVER = 0.6
BLOCK_WORDS = 2_000_000
_punctuation = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_punctuation).split() if text else []


class Items:
    """Benchmark items as flat arrays: words, their hashes, and for each size of seed the places where each seed stands."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        words = [normal_words(t) for _, t in rows]
        self.words = [b" ".join(w) for w in words]
        self.hashes, self.starts = flat_hashes(words)
        self.lengths = np.diff(self.starts)
        self.sizes = sorted({min(SEED, len(w)) for w in words if w})
        self.seeds, self.bounds, self.item, self.place, self.bits = {}, {}, {}, {}, {}
        for size in self.sizes:
            runs = grams(self.hashes, size)
            ok = inside(self.starts, size, len(runs))
            owner = np.repeat(np.arange(len(words)), self.lengths)[: len(runs)]
            ok &= np.minimum(SEED, self.lengths[owner]) == size
            at = np.flatnonzero(ok)
            at = at[np.argsort(runs[at], kind="stable")]
            seeds, first = np.unique(runs[at], return_index=True)
            self.seeds[size], self.bounds[size] = seeds, np.append(first, len(at))
            self.item[size], self.place[size] = owner[at], at - self.starts[owner[at]]
            bits = np.zeros(1 << 16, bool)
            bits[(seeds & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.bits[size] = bits


class _Windows:
    """Running Karp-Rabin: the hash of any run of words from sums of powers, modulo 2**64."""

    _base, _back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, hashes: np.ndarray):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), self._base, np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * power[:-1], dtype=np.uint64)]
        self.shift = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), self._back, np.uint64)], dtype=np.uint64)
        self.marked = np.zeros(len(hashes), bool)

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of runs of this size without a marked word, and their hashes."""
        n = len(self.marked) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.r_[0, np.cumsum(self.marked)]
        at = np.flatnonzero(taken[size:] == taken[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.shift[at]


def tiles(doc: np.ndarray, item: np.ndarray, size: int, same: Callable[[int, int, int], bool]) -> list[tuple[int, int, int]]:
    """(place in the item, in the document, words) of each tile of at least `size` words; same(i, d, n) compares the words.

    Longest first: the greatest length that a match of unmarked words has is found by bisection, as a match holds shorter
    ones; all matches of that length are taken in order, each at its first free place of the document. The lengths add
    up to the item at most, so there are few different ones.
    """
    mine, theirs, found = _Windows(item), _Windows(doc), []
    common = lambda n: bool(np.isin(mine.free(n)[1], theirs.free(n)[1]).any())
    longest = min(len(doc), len(item))
    while longest >= size:
        if not common(longest):
            low, high = size - 1, longest  # a match at low, none at high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if common(middle) else (low, middle)
            longest = low
            if longest < size:
                break
        (at, of), (places, hashes) = mine.free(longest), theirs.free(longest)
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        here = np.isin(of, hashes)
        first, last = np.searchsorted(hashes, of[here]), np.searchsorted(hashes, of[here], "right")
        reach: dict[int, int] = {}  # where the runs of a hash are used up to
        behind = -1
        for i, a, b in zip(at[here].tolist(), first.tolist(), last.tolist(), strict=True):
            if i < behind:
                continue
            k = reach.get(a, a)
            while k < b and theirs.marked[places[k] : places[k] + longest].any():
                k += 1
            reach[a] = k
            for d in places[k:b].tolist():
                if not theirs.marked[d : d + longest].any() and same(i, d, longest):
                    mine.marked[i : i + longest] = theirs.marked[d : d + longest] = True
                    found.append((i, d, longest))
                    behind = i + longest
                    break
        longest -= 1
    return found


def leaks_in(texts: list[str | None], items: Items, cover: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words of the item, words covered, tiles) for every leaked item of every text."""
    parts = [normal_words(t) for t in texts]
    flat, starts = flat_hashes(parts)
    found = []
    for size in items.sizes:
        runs = grams(flat, size)
        near = items.bits[size][(runs & np.uint64(0xFFFF)).astype(np.int64)]
        near &= inside(starts, size, len(runs))
        places = np.flatnonzero(near)
        seeds, bounds = items.seeds[size], items.bounds[size]
        number = np.minimum(np.searchsorted(seeds, runs[places]), len(seeds) - 1)
        hit = seeds[number] == runs[places]
        text = np.searchsorted(starts, places[hit], "right") - 1
        held = np.unique(text * len(seeds) + number[hit])  # each seed of a text once
        if not len(held):
            continue
        text, number = held // len(seeds), held % len(seeds)
        n = bounds[number + 1] - bounds[number]
        at = np.repeat(bounds[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, place = np.repeat(text, n) * len(items.ids) + items.item[size][at], items.place[size][at]
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        # no tiling can cover words that no shared seed holds
        step = np.minimum(size, np.where(np.r_[pair[1:] == pair[:-1], False], np.diff(np.r_[place, 0]), size))
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        most = np.add.reduceat(step, begin)
        for t, k, words in zip((pair[begin] // len(items.ids)).tolist(), (pair[begin] % len(items.ids)).tolist(), most.tolist(), strict=True):
            length = int(items.lengths[k])
            if words < cover * length:
                continue
            item, item_words = items.hashes[items.starts[k] : items.starts[k + 1]], items.words[k].split()
            same = lambda i, d, n: item_words[i : i + n] == parts[t][d : d + n]  # noqa: B023, E731
            marked = tiles(flat[starts[t] : starts[t + 1]], item, size, same)
            covered = sum(n for _, _, n in marked)
            if covered >= cover * length:
                found.append((t, k, length, covered, len(marked)))
    return found


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(normal_words(row["text"]))
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((row["item_id"], row["text"]))
        words += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, item_words, covered_words, n_tiles, coverage."""
    spark, out = docs.sparkSession, None
    kinds = {"doc_id": dict(docs.dtypes)["doc_id"], "item_id": dict(benchmark.dtypes)["item_id"]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, item_words long, covered_words long, n_tiles long, coverage double"
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(Items(block))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for part in slices(batches, "text"):
                rows = leaks_in(part.column(1).to_pylist(), items, cover)
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                names = pa.array([items.ids[r[1]] for r in rows], item_type)
                counts = [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
                share = pa.array([r[3] / r[2] for r in rows], pa.float64())
                yield pa.record_batch([ids, names, *counts, share], names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage"])

        item_type = pa.string() if kinds["item_id"] == "string" else pa.int32() if kinds["item_id"] == "int" else pa.int64()
        part = durable(docs.select("doc_id", "text").mapInArrow(find, schema), "leaks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents that leak no item, with all their columns, in one pass for each block and without a shuffle.

    What a block leaves is written before the next is sent, so that one block is with the executors at a time."""
    spark, last = docs.sparkSession, None
    for block in blocks(benchmark):
        if last is not None:
            docs = durable(docs, "unleaked")
            last.destroy()
        sent = spark.sparkContext.broadcast(Items(block))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                bad = {r[0] for r in leaks_in(texts, sent.value, cover)}
                yield part.filter(pa.array([k not in bad for k in range(part.num_rows)]))

        docs, last = docs.mapInArrow(keep, docs.schema), sent
    return docs
