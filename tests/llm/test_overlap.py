import random
import re

import pytest

from weftgraph.llm import overlap


def words(seed, n, vocabulary):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4)))


def slow(rows, threshold=80):
    """(doc_id, n, component) of rows (doc_id, text), every pair compared."""
    sets = [(k, shingles(text)) for k, text in rows]
    label = {k: k for k, _ in rows if k is not None}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if common and None not in (a, b) and 100 * common >= threshold * (len(x) + len(y) - common):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(((k, len(x), None if k is None else root(k)) for k, x in sets), key=str)


def check(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, overlap.join_components(frame, **more).collect()), key=str) == slow(rows, **more)


def test_equals_all_pairs(docs, doc_rows):
    found = sorted(map(tuple, overlap.join_components(docs).collect()), key=str)
    assert found == slow([(k, text) for k, text, *_ in doc_rows])


def changed(base, n, rng):
    out = list(base)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"c{rng.randrange(10**9)}"
    return " ".join(out)


def test_group_of_copies_around_the_threshold(spark):
    """Copies that the lead row doesn't reach, chains of small changes, and a notice that all texts share."""
    rng, base, notice = random.Random(5), words("base", 120, 10**6), words("notice", 40, 10**6)
    rows = [(k, changed(base, rng.choice((1, 2, 3, 4, 5)), rng)) for k in range(60)]
    chain = words("chain", 100, 10**6)
    for k in range(100, 140):
        chain = changed(chain, 1, rng).split()
        rows.append((k, " ".join(chain)))
    rows += [(k, " ".join(notice + words(f"own{k}", rng.choice((5, 9, 30)), 10**6))) for k in range(200, 260)]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabulary(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), " ".join(rng.choice(("a b c d e f", "a b c d e", "a b", "B", "f e d c b a")) for _ in range(rng.randrange(4)))) for _ in range(60)]
    merged = {}
    for k, text in rows:
        merged.setdefault(k, text)
    check(spark, sorted(merged.items()))


def test_exactly_at_the_threshold(spark):
    base = [f"w{k}" for k in range(13)]  # 9 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[:-2]))]  # 8 of 9 link, 7 of 9 don't but through 2
    check(spark, rows)
    check(spark, [rows[0], rows[2]])
    check(spark, [(1, "one two three"), (2, "ONE two three"), (3, "One Two"), (4, None), (5, "")])
    check(spark, rows, threshold=90)


def test_empty_table(no_docs):
    assert overlap.join_components(no_docs).collect() == []


def test_texts_made_of_common_passages(spark):
    """Rows far from the lead rows of their columns, copies of such rows, and copies of a group that are not like its lead row."""
    rng = random.Random(9)
    pool = [words(f"pool{k}", 40, 10**6) for k in range(12)]
    rows = []
    for k in range(70):
        body = [w for p in rng.sample(range(12), 3) for w in pool[p]] + words(f"own{k}", rng.choice((0, 0, 6)), 10**6)
        rows.append((k, " ".join(body)))
        if k % 5 == 0:
            rows.append((500 + k, changed(body, rng.choice((1, 2, 4)), rng)))
    base = words("star", 150, 10**6)
    for k in range(40):
        body = list(base)
        body[: 8 + k % 4] = words(f"head{k % 6}", 8 + k % 4, 10**6)
        rows.append((1000 + k, changed(body, k % 3, rng)))
    check(spark, rows)
