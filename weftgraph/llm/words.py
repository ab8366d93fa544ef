"""Words of texts as arrays of 64-bit hashes, made in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1_500_000
TABLE_SIZE = 300_000

_one: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def only_one(name: str, make: Callable[[], object]) -> object:
    """This worker's memory called `name`; workers outlive tasks, so any other operator's memory makes room for it."""
    if name not in _one:
        _one.clear()
        _one[name] = make()
    return _one[name]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside the executor, and both count towards one limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `limit` bytes of `column`, each of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, np.int64)
        lengths = pc.fill_null(pc.binary_length(text), 0)
        sizes[:] = np.asarray(lengths)
        ends, start, run = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, run + limit, "right")))
            yield batch.slice(start, stop - start)
            run, start = int(ends[stop - 1]), stop
        give_back()


def runs_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of the batches in tables of `rows` rows at least, but the last."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
            give_back()
    if n:
        yield pa.Table.from_batches(held)


def split(text: str | None) -> list[bytes]:
    """Words as `[^\\x20\\x09-\\x0D]+`, in UTF-8; none for a null."""
    return text.encode().split() if text else []


def split_lower(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def flat_hashes(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in one array, and where each text's words begin (and the end)."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    known = only_one("hashes", _Hashes)
    if len(known) > TABLE_SIZE:
        known.clear()
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.uint64, int(starts[-1]))
    return flat, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` neighbouring words; the caller leaves out runs that cross texts."""
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += flat[k : k + n]
    return mix(out)


def inside(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether the run of `size` words at each of n places stays within its text."""
    ok = np.ones(n, bool)
    for end in starts[1:-1]:
        ok[max(0, end - size + 1) : min(end, n)] = False
    return ok
