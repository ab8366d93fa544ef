"""Which runs of words may stand on many pages, told by hashes of 64 bits without a shuffled row for each run.

Hashes are dealt to BUCKETS by their first 10 bits and shuffled as packed blocks with 32 bits of each; those that are on enough pages
fill a Bloom filter of SIEVE_BYTES at most, which every worker holds. All runs that are common pass it, and few others do, so what
passes must be counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from weftgraph.storage import drop, durable, releasing

BUCKETS, SHIFT = 1024, 54
#: Hashes that are packed at once, and the most that the filter takes; the driver holds it for a moment.
BLOCK, SIEVE_BYTES = 2_000_000, 32 << 20
BLOCKS = "bucket int, hashes binary"
_MIX, _PROBES = np.uint64(0x9E3779B97F4A7C15), (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def run_hashes(tokens: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the run of `size` tokens that starts at each place, and whether the run ends within its page; by 64-bit hashes of
    tokens, those of page k from offsets[k] on."""
    n = max(len(tokens) - size + 1, 0)
    tokens, found = tokens.view(np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        found = (found ^ tokens[k : k + n]) * _MIX
        found ^= found >> np.uint64(29)
    whole = np.ones(n, bool)
    for end in offsets[1:]:
        whole[max(end - size + 1, 0) : end] = False
    return found, whole


def pack(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of these hashes, given as those of a page without repeats, each of one bucket."""
    held, n = [], 0
    for hashes in found:
        held.append(hashes)
        n += len(hashes)
        if n >= BLOCK:
            yield _blocks(held)
            held, n = [], 0
    if n:
        yield _blocks(held)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(SHIFT)).astype(np.int64), (hashes >> np.uint64(SHIFT - 32)).astype(np.uint32)


def _blocks(held: list[np.ndarray]) -> pa.RecordBatch:
    bucket, rest = _places(np.sort(np.concatenate(held)))
    parts = np.split(rest, np.searchsorted(bucket, np.arange(1, BUCKETS)))
    some = [k for k, part in enumerate(parts) if len(part)]
    return pa.record_batch([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["bucket", "hashes"])


def _probes(rest: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for factor in _PROBES:
        yield ((rest * np.uint32(factor)) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Sieve:
    """A Bloom filter: 2 ** bits bits for each bucket."""

    held: Broadcast
    bits: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bucket, rest = _places(hashes)
        cells, ok = np.frombuffer(self.held.value, np.uint8), np.ones(len(hashes), bool)
        for at in _probes(rest, self.bits):
            at = (bucket << self.bits) + at
            ok &= (cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def sieve(blocks: DataFrame, least_pages: int) -> Sieve:
    """What lets the hashes through that are that often in blocks of pack()."""

    def often(table: pa.Table) -> pa.Table:
        rest, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in table["hashes"].to_pylist()]), return_counts=True)
        rest = rest[n >= least_pages]
        return pa.table({"bucket": table["bucket"][:1], "size": pa.array([len(rest)], pa.int64()), "hashes": pa.array([rest.tobytes()], pa.binary())})

    with releasing(blocks.sparkSession):
        told = durable(blocks.groupBy("bucket").applyInArrow(often, "bucket int, size long, hashes binary"), "common-hashes")
    most = told.agg(F.max("size")).first()[0] or 0
    bits = min(max(6, (16 * most).bit_length()), (SIEVE_BYTES * 8 // BUCKETS).bit_length() - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, rest in zip(batch["bucket"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                cells = np.zeros(1 << bits, bool)
                for at in _probes(np.frombuffer(rest, np.uint32), bits):
                    cells[at] = True
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([np.packbits(cells).tobytes()], pa.binary())], names=["bucket", "cells"])

    held, width = bytearray(BUCKETS << bits >> 3), 1 << bits >> 3
    for bucket, cells in told.select("bucket", "hashes").mapInArrow(fill, "bucket int, cells binary").toLocalIterator():
        held[bucket * width : (bucket + 1) * width] = cells
    drop(told)
    return Sieve(told.sparkSession.sparkContext.broadcast(bytes(held)), bits)
