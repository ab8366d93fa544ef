import re
from collections import Counter

from weftgraph.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_stats_against_brute_force(spark, docs, doc_rows):
    extra = [(900, "a b c a b c\n#x\n#x\n\n\n  \nab", None, None), (901, "a a a a", None, None), (902, "a b a b a", None, None)]
    more = spark.createDataFrame([(r[0], r[1]) for r in extra], "doc_id long, text string")
    got = quality.text_stats(docs.select("doc_id", "text").unionByName(more))
    rows = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()]
    assert Counter(rows) == Counter((d, *brute(t)) for d, t, *_ in [*doc_rows, *extra])


def test_learned_list_separates(spark):
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(80)) + (" ## $$" * 30 if k % 4 == 0 else "")) for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(80)] + [(999, 0), (3, None)], "doc_id long, quality int")
    stats = quality.text_stats(docs)
    rules = quality.learn_from(stats, labels)
    assert rules
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(stats, rules).collect()}
    assert all(k % 4 != 0 for k, (failed, keep) in kept.items() if keep)
    assert all(keep for k, (failed, keep) in kept.items() if k % 4 and not failed)


def test_rules_are_pruned_and_ordered():
    cuts = {f: [1.0] for f in quality.FEATURES}
    cells = [((1, 0, 0, 0, 0), 20, 0), ((0, 1, 1, 0, 0), 10, 0), ((0, 1, 0, 0, 0), 0, 30), ((0, 0, 1, 0, 0), 0, 30), ((0, 0, 0, 0, 0), 0, 40)]
    rules = quality.learn(cuts, cells)
    assert [len(r) for r in rules] == [1, 2]
    assert rules[0][0].feature == "symbol_share"


def test_without_labels_and_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn_from(quality.text_stats(docs), none) == []
    assert quality.judge(quality.text_stats(no_docs), []).collect() == []
