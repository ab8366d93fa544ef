import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold(nodes):
    """All levels of a tree, and for each leaf its siblings (left, right) level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + 3]) for k in range(0, len(last), 3)])
    paths = []
    for k in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = k - k % 3
            path.append(("".join(level[first:k]), "".join(level[k + 1 : first + 3])))
            k //= 3
        paths.append(path)
    return levels[-1][0], paths


def slow(rows):
    """Rows (doc_id, source, lang, n_chars, text) in any order; text loses line feeds where crc32 of doc_id is even."""
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in itertools.groupby(order, key=lambda r: r[1])]
    folded = [fold([leaf(r) for r in g]) for g in groups]
    root, tops = fold([subroot for subroot, _ in folded])
    out = []
    for group, (subroot, paths), top in zip(groups, folded, tops, strict=True):
        for row, path in zip(group, paths, strict=True):
            path = path + top
            text = row[4].replace("\n", "") if row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[0] is not None else row[4]
            back = leaf((*row[:4], text))
            for left, right in path:
                back = H(left, back, right)
            out.append((row[0], leaf(row), subroot, root, H(*(x for pair in path for x in pair)), back, back == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


def run(docs):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    received = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.manifest(docs, received).collect()), key=str)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), rng.choice((None, "en")), k * 3, rng.choice((None, "", "é\nx", "a\nb\n", "plain"))) for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(1, ["a"], 1),
        rows_of(3, ["a"], 2),
        rows_of(28, ["a"], 3),
        rows_of(200, ["a"], 4),
        rows_of(150, [None, "", "b", "é", "zz", "a"], 5),
        rows_of(120, [f"s{k}" for k in range(90)], 6),
        rows_of(200, ["hot"] * 60 + [f"s{k}" for k in range(40)], 7),
        [(k, f"s{k:03}", None, None, "x\n") for k in range(41)],
        rows_of(30, ["a", "b"], 8) + rows_of(30, ["a", "b"], 8) + [(None, "a", "en", 1, "x\ny"), (None, "a", "en", 1, "x\ny"), (4, "a", None, None, "other")],
        [(1, "a", "en", 5, "same")] * 50 + [(2, "a", "en", 5, "one")],
    ],
)
def test_equals_plain_trees(spark, rows):
    assert run(frame(spark, rows)) == slow(rows)


def test_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        rows = rows_of(400, ["a", "b", "b", "b", *"defgh"], 9)
        assert run(frame(spark, rows)) == slow(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_rows_of_the_fixture(docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert run(docs) == slow(rows)
    assert all(r.verified for r in merkle.manifest(docs).collect())


def test_merging_is_associative():
    rng = random.Random(1)
    leaves = [H(str(k)).encode() for k in range(100)]
    cuts = sorted(rng.sample(range(1, 100), 9))
    runs = [(a, leaves[a:b]) for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
    forests = [merkle.fragment([(merkle.Run(0, start, 100), own)], 1) for start, own in runs]
    left = forests[0]
    for f in forests[1:]:
        left = left.merge(f)
    right = forests[-1]
    for f in reversed(forests[:-1]):
        right = f.merge(right)
    order = rng.sample(forests, len(forests))
    mixed = order[0]
    for f in order[1:]:
        mixed = mixed.merge(f)
    root = fold([x.decode() for x in leaves])[0]
    assert left.open == right.open == mixed.open == {(merkle.TOP, 0, 0): root.encode()}
    assert left.folded == right.folded == mixed.folded


def test_empty_table(no_docs):
    assert merkle.manifest(no_docs).collect() == []
