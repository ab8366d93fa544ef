"""Quality rules as a learned decision list over text statistics, in DataFrame operations alone.

Sequential covering: conjunctions of thresholds are grown by FOIL gain towards low-quality labels, pruned while that
does not lower their precision, and what an accepted rule covers is taken away before the next is grown. The list is
emitted as one ordered CASE expression. Learning reads a contingency table of the labelled rows: every statistic is
cut at a few quantiles of all labelled rows, so the table has at most CUTS+1 to the power of the statistics' number
of cells, whatever the size of the input. CUTS, at most 12 rules and at most 3 conditions in a rule set the size of the model,
so that it stays readable; they leave out no row of the labels or the documents.

Defined cases: a null or empty text has zero in every count and fails the base rule; repeated doc_ids are judged
row by row; labels that are null or whose doc_id is not in the documents are not learned from; a doc_id with several
labels counts once for each; without labels the list is empty and the base rule alone decides. Windows of three words
are compared by 64-bit hashes. Only doc_id, text and the label columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.store import durable

SPACE = r"[\x20\x09-\x0D]"
CUTS = 5
FEATURES = ("symbol_share", "capital_share", "repeat_share", "dup_line_share", "word_length")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rule, and the shares that the learned list looks at, as a written table.

    Written, because a filter on a count would otherwise be pushed below and evaluate the arrays again for each word.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(
        "doc_id",
        words.alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    window = lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")
    )
    sized = read.withColumn("n", F.size("w"))
    windows = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), window))
    hashed = sized.select("*", F.array_sort(windows).alias("s")).drop("w")
    same = lambda x, k: (F.get("s", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("s", k - 1)["h"] == x["h"]))
    found = F.transform(F.filter("s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])
    at = hashed.select("*", F.array_sort(found).alias("p")).drop("s")
    step = lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))
    covered = F.aggregate(F.transform("p", step), F.lit(0), lambda a, x: a + x)
    counted = at.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_capitals",
        F.size("l").alias("n_lines"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    shares = counted.select(
        "*",
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("word_chars", "n_words").alias("word_length"),
    )
    return durable(shares, "quality-stats")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Cell = tuple[tuple[int, ...], int, int]  # place of each feature among its cuts, low-quality rows, other rows


def contingency(labelled: DataFrame) -> tuple[dict[str, list[float]], list[Cell]]:
    """The cuts of each feature and the counts of its cells. labelled: FEATURES and a boolean `low`."""
    marks = [0.25, 0.5, 0.8, 0.95, 0.99][:CUTS]
    row = labelled.agg(*(F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    place = lambda f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
    cells = (
        labelled.groupBy(*(place(f).alias(f) for f in FEATURES))
        .agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("other"))
        .collect()
    )
    return cuts, [(tuple(r[f] for f in FEATURES), r["low"], r["other"]) for r in cells]


def _counts(rule: tuple[tuple[int, bool, int], ...], cells: list[Cell]) -> tuple[int, int]:
    low = other = 0
    for places, n_low, n_other in cells:
        if all((places[f] > k) == above for f, above, k in rule):
            low, other = low + n_low, other + n_other
    return low, other


def learn(
    cuts: dict[str, list[float]],
    cells: list[Cell],
    least_precision: float = 0.9,
    least_support: int = 5,
    most_conditions: int = 3,
    most_rules: int = 12,
) -> list[Rule]:
    """The ordered list of rules that mark low quality."""
    # of equal gains the first wins: the cut that takes the fewest rows
    options = [(f, True, k) for f, name in enumerate(FEATURES) for k in reversed(range(len(cuts[name])))]
    options += [(f, False, k) for f, name in enumerate(FEATURES) for k in range(len(cuts[name]))]
    precision = lambda r: (lambda a, b: a / (a + b) if a + b else 0.0)(*_counts(r, left))
    rules: list[Rule] = []
    left = list(cells)
    while len(rules) < most_rules:
        rule: tuple = ()
        while len(rule) < most_conditions and (not rule or precision(rule) < 1):
            low, other = _counts(rule, left)
            if not low:
                break
            before = math.log2(low / (low + other))

            def gain(option: tuple[int, bool, int]) -> float:
                a, b = _counts((*rule, option), left)
                return a * (math.log2(a / (a + b)) - before) if a >= least_support else 0.0

            best = max(options, key=gain)
            if gain(best) <= 0:
                break
            rule = (*rule, best)
        for condition in rule:
            shorter = tuple(c for c in rule if c != condition)
            if shorter and precision(shorter) >= precision(rule):
                rule = shorter
        low, other = _counts(rule, left)
        if not rule or low < least_support or precision(rule) < least_precision:
            break
        rules.append(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, above, k in rule))
        left = [c for c in left if not all((c[0][f] > k) == above for f, above, k in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    chain = None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        chain = F.when(holds, number) if chain is None else chain.when(holds, number)
    return F.lit(None).cast("int") if chain is None else chain


def learn_from(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from labels(doc_id, quality), where 0 is low."""
    marks = labels.filter(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("low"))
    return learn(*contingency(stats.filter(~base_failed()).join(marks, "doc_id").select(*FEATURES, "low")))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, failed_rule and kept."""
    failed = stats.withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict(rules))
    return failed.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
