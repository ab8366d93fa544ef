"""Fill-in-middle: documents cut into prefix, middle and suffix at two units, and rearranged between sentinels.

Units are the isolated matches of a Split pre-tokenizer of the tokenizers library, which is never trained. For each text it
supplies an array of offsets: the array's length is the number of units, and the offsets at two ranks are the cuts. The default
unit is one code point. A match of one code point depends on nothing beside it, so a text is taken in windows of
WINDOW code points and these in words, whose offsets are remembered; any other unit is matched over the whole text at once.

Cuts, and which documents are left plain, follow from a hash of doc_id alone. A text rebuilds exactly from output and form:
no sentinel overlaps with itself or another, and texts that hold one are left plain.

Defined cases: a null text is empty; an empty text is plain. A null doc_id is hashed like an empty one. Repeated rows and equal
doc_ids are each cut by their own text. An empty table gives an empty table. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from weftgraph.llm.words import only_one, slices

CODE_POINT = r"\O"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are left plain, and of a hundred others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
WINDOW = 1_000_000
LONGEST_WORD, KNOWN_WORDS = 64, 300_000


class _Known(dict):
    """Offsets of words, as the pre-tokenizer gives them: where each unit starts."""

    def __init__(self, split: Split):
        super().__init__()
        self.split = split

    def offsets(self, text: str) -> tuple[int, ...]:
        return tuple(start for _, (start, _) in self.split.pre_tokenize_str(text))

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.offsets(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found


class Units:
    """The units of a text: their number, and the offsets of the units at given ranks."""

    def __init__(self, pattern: str = CODE_POINT):
        self.window = WINDOW if pattern == CODE_POINT else None
        self.known = only_one(f"units {pattern}", lambda: _Known(Split(Regex(pattern), "isolated")))

    def _arrays(self, part: str) -> tuple[list[str], list[tuple[int, ...]]]:
        """The window's words with the blanks between them, and the offsets of each from its own start."""
        if self.window is None:
            return [part], [self.known.offsets(part)]
        words = part.split(" ")
        pieces = [" "] * (2 * len(words) - 1)
        pieces[::2] = words
        return pieces, list(map(self.known.__getitem__, pieces))

    def _windows(self, text: str) -> range:
        size = self.window or max(1, len(text))
        return range(0, len(text), size)

    def count(self, text: str) -> int:
        """How many units the text has, which later calls of offset() are about: the lengths of its offset arrays."""
        self.text, self.counts = text, []
        for k in self._windows(text):
            self.open = k, *self._arrays(text[k : k + (self.window or len(text))])
            self.counts.append(sum(map(len, self.open[2])))
        return sum(self.counts)

    def offset(self, rank: int) -> int:
        """Where the unit of this rank starts; the end of the text for the rank after the last."""
        for begins, n in zip(self._windows(self.text), self.counts, strict=True):
            if rank < n:
                break
            rank -= n
        else:
            return len(self.text)
        if self.open[0] != begins:
            self.open = begins, *self._arrays(self.text[begins : begins + self.window])
        _, pieces, arrays = self.open
        ends = np.cumsum(np.fromiter(map(len, arrays), np.int64, len(arrays)))
        k = int(np.searchsorted(ends, rank, "right"))
        return begins + sum(map(len, pieces[:k])) + arrays[k][rank - int(ends[k]) + len(arrays[k])]


def hashes() -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of `1:` and doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def arrange(text: str, units: Units, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    n = units.count(text)
    if not text or h3 % 100 >= 100 - PLAIN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = units.offset(low), units.offset(high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, pattern: str = CODE_POINT) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output, a row for each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(pattern)
        for part in slices(batches, "text"):
            h = [part.column(k).to_pylist() for k in range(2, 6)]
            rows = [arrange(text or "", units, *of) for text, *of in zip(part.column(1).to_pylist(), *h, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            columns = [part.column(0), longs[0], pa.array(form), longs[1], longs[2], pa.array(output, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()))
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, t) for n, t in kinds)])
    return docs.select("doc_id", "text", *hashes()).mapInArrow(cut, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form."""
    parts = lambda first, second: F.split(F.substring(output, 4, 2**31 - 1), f"{first}|{second}", 3)  # noqa: E731  after the leading sentinel
    psm, spm = parts(SUFFIX, MIDDLE), parts(PREFIX, MIDDLE)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )


ORACLE = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), u AS (
    SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
           ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4 FROM t
), f AS (
    SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b,
           CASE WHEN n = 0 OR r3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
    SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
