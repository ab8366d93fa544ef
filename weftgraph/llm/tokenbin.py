"""Token ids in grammar-compressed shards, in ascending doc_id order.

Documents are dealt to partitions by ranges of doc_id, encoded, and packed into shards of about SHARD_IDS ids. Each shard
is compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by nonterminals, each where it is more frequent
than the pairs that overlap it, until no pair is seen LEAST_COUNT times. A document's end id is in no pair, so every
document is a slice of the compressed symbols. A shard's bytes, all little-endian, are

    magic `WRP1`; u32 first nonterminal, documents, rules, symbols; u8 bytes for each symbol
    i64 doc_id and u8 null mark of each document, u64 ids and u64 first symbol of each document
    u32 left and right of each rule, u32 expansion length of each rule
    the symbols

A rule refers to ids and earlier rules only. The lengths let a reader find the ids of one document, or of a part of it,
without expanding the rest. Shards are rows (part, shard, offset, n_ids, payload) of a Parquet table, so that they are
written and read by any store that Spark knows. The place of a partition's first id follows from the totals of the
partitions, one number for each.

Defined cases: a null or empty text is the end id alone; equal doc_ids are ordered by text; a null doc_id comes first;
an empty table gives no rows. Strings of special tokens inside a text become what the tokenizer makes of them. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm.store import new_path
from weftgraph.llm.words import only_one, slices

END = 2
SHARD_IDS = 1_000_000
LEAST_COUNT = 12  # a rule takes 12 bytes and each use of it saves two
CACHE = 300_000
JOINED = 100
TEXT_BYTES = 6_000_000  # of text encoded at once: looking words up has a cost for each time
CELL_BITS, FEW = 18, 50_000
_MAGIC = b"WRP1"
_HEAD = struct.Struct("<4sIIIIB")
_BREAK = np.uint32(0xFFFFFFFF)  # stands for a document's end id
_SPACE = "\u0120"  # how byte-level vocabularies write a space
_WHITE = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space before a space: there, and where more follows or the text ends, the tokenizer looks across the space.
_ACROSS = f"[{_WHITE}] "
#: Letters in every version of Unicode that a tokenizer may know; the byte-level pattern takes a word of them as one piece.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0220\u0400-\u0481]+$"
#: Marks that are one piece of the byte-level pattern where they follow letters and a space or the end follows them.
_MARKS = string.punctuation


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The elements of `flat` from each of `begin` on, `size` of them, one run after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


class Known:
    """Words, and the ids of each with a space before it."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def __contains__(self, word: str) -> bool:
        return pc.index(self.words, pa.scalar(word, pa.large_string())).as_py() >= 0

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """Words that are not here yet, their ids one after the other, and how many each has."""
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]


class Encoder:
    """Ids of texts. No piece of the byte-level pattern holds a space but at its start, so words are encoded once.

    New words are encoded JOINED at a time, with a space before each; an id that begins with a space begins a word. Words
    of letters alone are one piece of the pattern each, so they are cut at the spaces without it.
    Marks after the letters of a word are another piece: letters are looked up without them, so a word is learnt once.
    Words are remembered in two halves: what is met again moves to the young half, and when that is full the old half is
    forgotten, so words met once do not drive out those met often.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cutter = Tokenizer(self.tokenizer.model)
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cutter.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), bytes_only])
        self.base = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_ACROSS, *map(re.escape, self.added)])
        self.opens = np.zeros(self.base, bool)  # ids of tokens that begin with a space
        self.opens[[k for token, k in self.tokenizer.get_vocab().items() if token.startswith(_SPACE)]] = True
        pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f" a{_MARKS}")]
        self.marks_apart = pieces == [f"{_SPACE}a", _MARKS]
        self.young, self.old = Known(), Known()

    @classmethod
    def at(cls, path: str) -> Encoder:
        return only_one(f"encoder {path}", lambda: cls(path))

    def _ids(self, texts: list[str], tokenizer: object = None) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space before it, by one call for each; and how many each has."""
        found = self._ids([f" {w}" for w in words.to_pylist()])
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _spaced(self, words: pa.Array, tokenizer: object) -> tuple[np.ndarray, np.ndarray]:
        """The same, for words without white space at their ends."""
        cuts = pa.array([*range(0, len(words), JOINED), len(words)], pa.int32())
        texts = [f" {t}" for t in pc.binary_join(pa.ListArray.from_arrays(cuts, words), pa.scalar(" ", words.type)).to_pylist()]
        if any(mark in t for mark in self.added if " " in mark for t in texts):
            return self._apart(words)
        ids = np.frombuffer(b"".join([b for k in range(0, len(texts), 500) for b in self._ids(texts[k : k + 500], tokenizer)]), "<u4")
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(words):
            raise ValueError("not a byte-level tokenizer that begins a piece at every space")
        return ids, np.diff(np.append(begin, len(ids)))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the young half."""
        if len(self.young) > CACHE:
            self.young, self.old = Known(), self.young
        young, old = self.young, self.old
        place = young.find(words)
        rest = np.flatnonzero(place < 0)
        if len(rest):
            missing = words.take(pa.array(rest))
            before = old.find(missing)
            again, new = np.flatnonzero(before >= 0), before < 0
            bare = np.asarray(pc.and_(pc.not_equal(missing, ""), pc.equal(pc.utf8_rtrim(missing, _WHITE), missing)))
            letters = np.asarray(pc.match_substring_regex(missing, _LETTERS))
            place[rest[again]] = len(young) + np.arange(len(again))
            at = before[again]
            young.add(missing.take(pa.array(again)), _runs(old.ids, old.begin[at], old.size[at]), old.size[at])
            for which, tokenizer in ((new & letters, self.cutter), (new & bare & ~letters, self.tokenizer), (new & ~bare, None)):
                some = np.flatnonzero(which)
                if len(some):
                    found = missing.take(pa.array(some))
                    place[rest[some]] = len(young) + np.arange(len(some))
                    young.add(found, *(self._spaced(found, tokenizer) if tokenizer else self._apart(found)))
        return place

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space before it, one after the other; and how many each has."""
        bare = pc.utf8_rtrim(words, _MARKS)
        long, short = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (words, bare))
        marked = np.flatnonzero((short < long) & np.asarray(pc.match_substring_regex(bare, _LETTERS))) if self.marks_apart else short[:0]
        if not len(marked):
            place = self._learn(words)
            return _runs(self.young.ids, self.young.begin[place], self.young.size[place]), self.young.size[place]
        cut = np.zeros(len(words), bool)
        cut[marked] = True
        coded = pc.if_else(pa.array(cut), bare, words).dictionary_encode()
        place = self._learn(coded.dictionary)[np.asarray(coded.indices)]
        whole = words.take(pa.array(marked))
        ends, values = (np.frombuffer(x, kind) for x, kind in zip(whole.buffers()[1:], (np.int64, np.uint8), strict=True))
        size = (long - short)[marked]
        tails = _runs(values, ends[: len(marked)] + short[marked], size).tobytes()
        tails = pa.Array.from_buffers(pa.large_string(), len(marked), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(tails)]).dictionary_encode()
        found = self._ids(tails.dictionary.to_pylist())  # a few marks
        of = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.r_[self.young.ids, np.frombuffer(b"".join(found), "<u4")]
        begin, n = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)  # of letters, of marks
        begin[:, 0], n[:, 0] = self.young.begin[place], self.young.size[place]
        which = np.asarray(tails.indices)
        begin[marked, 1], n[marked, 1] = (len(self.young.ids) + np.cumsum(of) - of)[which], of[which]
        return _runs(flat, begin.ravel(), n.ravel()), n.sum(1)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian u32, without the end id."""
        rows = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out: list[bytes] = [b""] * len(rows)
        some = np.asarray(pc.fill_null(pc.not_equal(rows, ""), False))
        whole = np.asarray(pc.fill_null(pc.match_substring_regex(rows, self.whole), False))
        apart, cut = np.flatnonzero(some & whole), np.flatnonzero(some & ~whole)
        for k, ids in zip(apart.tolist(), self._ids(rows.take(pa.array(apart)).to_pylist()), strict=True):
            out[k] = ids
        if not len(cut):
            return out
        parts = pc.split_pattern(rows.take(pa.array(cut)), " ")
        coded, bounds = parts.flatten().dictionary_encode(), np.asarray(parts.offsets)
        words, code = coded.dictionary, np.asarray(coded.indices)
        # a text's first word has no space before it
        heads = self._ids(words.take(pa.array(code[bounds[:-1]])).to_pylist())
        ids, size = self._coded(words)
        place = code.astype(np.int64)
        place[bounds[:-1]] = len(words) + np.arange(len(heads))
        size = np.r_[size, np.fromiter(map(len, heads), np.int64, len(heads)) // 4]
        begin = np.cumsum(size) - size
        flat, n = np.r_[ids, np.frombuffer(b"".join(heads), "<u4")], size[place]
        joined = _runs(flat, begin[place], n).tobytes()
        ends = np.r_[0, np.cumsum(n)][bounds] * 4
        for k, x, y in zip(cut.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = joined[x:y]
        return out


def _frequent(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the codes are of pairs that occur LEAST_COUNT times, the number of the pair of each, the pairs, their counts."""
    some, cell = np.arange(len(code)), None
    if len(code) > FEW:  # a pair is at most as frequent as its cell
        cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        some = np.flatnonzero((np.bincount(cell, minlength=1 << CELL_BITS) >= LEAST_COUNT)[cell])
        code, cell = code[some], cell[some]
    ordered = np.sort(code)
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(code)])
    pairs, n = ordered[begin[n >= LEAST_COUNT]], n[n >= LEAST_COUNT]
    if not len(pairs):
        return some[:0], some[:0], pairs, n
    if cell is None:
        number = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
    else:  # look numbers up by cell, and only where pairs share one by search
        of_pair = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        table, shared = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << CELL_BITS, bool)
        table[of_pair] = np.arange(len(pairs))
        shared[of_pair[table[of_pair] != np.arange(len(pairs))]] = True
        number, search = table[cell], np.flatnonzero(shared[cell])
        number[search] = np.minimum(np.searchsorted(pairs, code[search]), len(pairs) - 1)
    here = pairs[number] == code
    return some[here], number[here], pairs, n


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document and the end, rules); the ids of a document end with END.

    In a round a pair is replaced wherever it is more frequent than both pairs that overlap it, so the most frequent pair is
    replaced everywhere. Only places beside a change, or of pairs that are still frequent, are looked at again. Symbols are
    linked to their neighbours, so that a round costs what it looks at.
    """
    size, rules, number = len(ids), [np.zeros((0, 2), np.uint32)], base
    seq = np.append(ids, _BREAK).astype(np.uint32)
    seq[starts[1:] - 1] = _BREAK
    after, before = np.arange(1, size + 2), np.arange(-1, size)
    live, held, placed = np.ones(size + 1, bool), np.ones(size + 1, bool), np.zeros(size + 2, np.int32)
    while True:
        at = np.flatnonzero(live)
        at = at[seq[at] != _BREAK]
        left, right = seq[at], seq[after[at]]
        inner = right != _BREAK
        at, left, right = at[inner], left[inner], right[inner]
        twin = at[left == right]
        some, which, pairs, n = _frequent((left.astype(np.uint64) << np.uint64(32)) | right)
        if not len(pairs):
            break
        at = at[some]
        live[:] = False
        live[at] = live[twin] = True
        valid = at
        if len(twin):  # in a run of one symbol every other pair can be replaced
            run = np.flatnonzero(np.r_[True, twin[1:] != after[twin[:-1]]])
            place = np.arange(len(twin)) - np.repeat(run, np.diff(np.r_[run, len(twin)]))
            even = np.ones(size + 1, bool)
            even[twin[place % 2 == 1]] = False
            valid, which = at[even[at]], which[even[at]]
        rank = np.empty(len(pairs), np.int32)
        rank[np.lexsort((pairs, n))] = np.arange(1, len(pairs) + 1)
        mine = rank[which]
        placed[valid] = mine  # the last place stands for "before the first", as before has -1 there
        best = (mine > placed[before[valid]]) & (mine > placed[after[valid]])
        placed[valid] = 0
        won = np.bincount(which[best], minlength=len(pairs))
        chosen = np.flatnonzero(2 * won >= n)  # the most frequent pair always is
        chosen = chosen[np.argsort(-rank[chosen])]
        name = np.zeros(len(pairs), np.uint32)
        name[chosen] = number + np.arange(len(chosen))
        best &= name[which] > 0
        at, which = valid[best], which[best]
        seq[at] = name[which]
        gone = after[at]
        held[gone] = live[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        live[at] = True
        live[before[at[before[at] >= 0]]] = True
        rules.append(np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        number += len(chosen)
    seq = seq[:size][held[:size]]
    ends = np.flatnonzero(seq == _BREAK)
    seq[ends] = ids[starts[1:] - 1]
    return seq, np.r_[0, ends + 1], np.concatenate(rules)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1))
    return np.array(size, np.uint32)


def pack(doc_ids: list[int | None], ids: list[bytes], base: int) -> bytes:
    """A shard of documents, given the ids of each with its end id."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    n = np.array([len(x) // 4 for x in ids], "<u8")
    starts = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    symbols, first, rules = compress(flat, starts, base)
    wide = 2 if base + len(rules) <= 0xFFFF else 4
    return b"".join(
        [
            _HEAD.pack(_MAGIC, base, len(ids), len(rules), len(symbols), wide),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            n.tobytes(),
            first[:-1].astype("<u8").tobytes(),
            rules.astype("<u4").tobytes(),
            lengths_of(rules, base).astype("<u4").tobytes(),
            symbols.astype("<u2" if wide == 2 else "<u4").tobytes(),
        ]
    )


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        magic, self.base, docs, rules, symbols, wide = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.n_ids, self.first = take("<u8", docs), np.append(take("<u8", docs), symbols).astype(np.int64)
        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take("<u2" if wide == 2 else "<u4", symbols)
        self._offsets = self._table = None

    def _expansions(self) -> None:
        known: list[bytes] = []  # rules refer to earlier ones only
        of = lambda x: known[x - self.base] if x >= self.base else x.to_bytes(4, "little")
        for a, b in self.rules.tolist():
            known.append(of(a) + of(b))
        self._offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self._table = np.frombuffer(b"".join(known), "<u4")

    def expand(self, begin: int, end: int) -> np.ndarray:
        """The ids of the symbols from begin to end."""
        if self._table is None:
            self._expansions()
        part = self.symbols[begin:end].astype(np.uint32)
        rule = np.flatnonzero(part >= self.base)
        which = part[rule].astype(np.int64) - self.base
        at, size = len(self._table) + np.arange(len(part)), np.ones(len(part), np.int64)
        at[rule], size[rule] = self._offsets[which], self.sizes[which]
        return _runs(np.concatenate([self._table, part]), at, size)

    def document(self, k: int) -> np.ndarray:
        return self.expand(int(self.first[k]), int(self.first[k + 1]))

    def all_documents(self) -> Iterator[tuple[int | None, bytes]]:
        data, at = self.expand(0, len(self.symbols)).astype("<u4").tobytes(), 0
        for d, n in zip(self.doc_ids, self.n_ids.tolist(), strict=True):
            yield d, data[at : at + 4 * n]
            at += 4 * n


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode docs(doc_id, text) and write the shards as a table at path."""
    end_bytes = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), Encoder.at(tokenizer)
        ids: list[bytes] = []
        names: list[int | None] = []
        held = offset = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, offset, number
            row = [part, number, offset, held, pack(names, ids, coder.base)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            batch = pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "offset", "n_ids", "payload"])
            ids.clear()
            names.clear()
            number, offset, held = number + 1, offset + held, 0
            return batch

        for piece in slices(batches, "text", TEXT_BYTES):
            for d, x in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1)), strict=True):
                n = len(x) // 4 + 1
                if ids and held + n > SHARD_IDS:
                    yield close()
                ids.append(x + end_bytes)
                names.append(d)
                held += n
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")  # the ranges' sample holds ids alone
    shards = ranged.mapInArrow(encode, "part int, shard int, offset long, n_ids long, payload binary")
    shards.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards at path."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each file
    bases = accumulate((r["n"] for r in totals), initial=0)
    placed = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, bases)], "part int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for d, ids in Shard(payload.as_py()).all_documents():
                    rows.append((d, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    based = shards.join(F.broadcast(placed), "part").select((F.col("base") + F.col("offset")).alias("start"), "payload")
    return based.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the shards, by default to a new place in the shared folder, and read them back."""
    path = path or new_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_shards(docs.sparkSession, path)
