"""Mixing documents to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are raked: scaled to the target share of each
source, then of each language, then of each topic, again and again until all three marginals hold. A document is
drawn if a hash of its doc_id falls below its cell's probability, which is the cell's fitted weight per token it
has, scaled so that the chosen number of tokens is expected and no probability exceeds 1 where that is possible.

Targets flatten the corpus: a category's target share is its token share to the power of TEMPERATURE, normalised; or they
are given. The fit sees one number for each occupied cell, not the documents. Up to FIT_CELLS cells it runs on the driver;
more, as millions of sources make, are raked by the same steps as tables on the executors.

Defined cases: null source, lang or text count as the category `(none)`, and no tokens; an empty table gives an empty
result; repeated rows and equal doc_ids are drawn together; a null doc_id hashes like any other. Targets of categories
that do not occur are left out and the others rescaled. Only doc_id, text, source and lang are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.store import durable

TEMPERATURE = 0.5
SHARE_KEPT = 0.5
STEPS = 60
FIT_CELLS = 200_000
AXES = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse kind of text: tables, lists of lines, short notes, long reads or plain prose."""
    marks = F.regexp_count(text, F.lit(r"[|#*$%&]"))
    return (
        F.when(marks * 5 > tokens, "marked")
        .when(tokens < 100, "note")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def cells_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every row."""
    none = F.lit("(none)")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), text.alias("t"))
    sized = sized.withColumn("n_tokens", n_tokens(F.col("t")))
    return sized.select("doc_id", "source", "lang", topic(F.col("t"), F.col("n_tokens")).alias("topic"), "n_tokens")


def flattened(tokens: dict[str, float], power: float = TEMPERATURE) -> dict[str, float]:
    raised = {k: v**power if v > 0 else 0.0 for k, v in tokens.items()}
    return {k: v / max(sum(raised.values()), 1e-300) for k, v in raised.items()}


def rake(cells: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Weights with the targets' marginals. members: for each axis the category's number of each cell."""
    w = cells / max(cells.sum(), 1e-300)
    for _ in range(steps):
        before = w
        for number, target in zip(members, targets, strict=True):
            held = np.bincount(number, w, len(target))
            w = w * np.divide(target, held, out=np.zeros(len(target)), where=held > 0)[number]
        if np.abs(w - before).max(initial=0) < 1e-12:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """A cell's chance such that the chosen tokens are `budget` in all and in proportion to the weights, none over 1."""
    p = np.zeros(len(tokens))
    open_ = (tokens > 0) & (weights > 0)
    left = min(budget, float(tokens[open_].sum()))
    while open_.any():
        scale = left / weights[open_].sum()
        want = np.divide(weights * scale, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
        over = open_ & (want >= 1)
        if not over.any():
            p[open_] = want[open_]
            break
        p[over] = 1
        left -= float(tokens[over].sum())
        open_ &= ~over
    return p


def _goal(held: dict[str, float], given: dict[str, float] | None) -> dict[str, float]:
    """The target shares of categories with tokens; those of others are 0."""
    wanted = {k: given.get(k, 0.0) for k in held} if given else flattened(held)
    wanted = {k: w if held[k] > 0 else 0.0 for k, w in wanted.items()}
    total = sum(wanted.values())
    return {k: w / total for k, w in wanted.items()} if total else wanted


def fit(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE_KEPT) -> DataFrame:
    """source, lang, topic, cell_weight, probability of each occupied cell of cells(source, lang, topic, n_tokens)."""
    summed = cells.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    table = summed.limit(FIT_CELLS + 1).toPandas()
    if len(table) > FIT_CELLS:
        return fit_wide(durable(summed, "mix-cells"), targets, share)
    table = table.sort_values(list(AXES))
    tokens = table["tokens"].to_numpy(float)
    members, wanted = [], []
    for axis in AXES:
        names = sorted(set(table[axis]))
        number = {n: i for i, n in enumerate(names)}
        member = table[axis].map(number).to_numpy(int) if names else np.zeros(0, int)
        held = np.bincount(member, tokens, len(names)) if names else np.zeros(0)
        goal = _goal(dict(zip(names, held, strict=True)), (targets or {}).get(axis))
        members.append(member)
        wanted.append(np.array([goal[n] for n in names]))
    weight = rake(tokens, members, wanted)
    p = probabilities(tokens, weight, share * float(tokens.sum()))
    rows = [(*map(str, k), float(w), float(q)) for k, w, q in zip(table[list(AXES)].itertuples(index=False, name=None), weight, p, strict=True)]
    fitted = cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, cell_weight double, probability double")
    return F.broadcast(fitted)  # FIT_CELLS rows at most


def fit_wide(cells: DataFrame, targets: dict[str, dict[str, float]] | None, share: float) -> DataFrame:
    """The same fit of cells(source, lang, topic, tokens), where these are too many for the driver."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for axis in AXES:
        held = cells.groupBy(axis).agg(F.sum("tokens").alias("held"))
        if given := (targets or {}).get(axis):
            named = spark.createDataFrame(list(given.items()), f"{axis} string, wanted double")
            wanted = held.join(named, axis, "left").withColumn("wanted", F.when(F.col("held") > 0, F.coalesce("wanted", F.lit(0.0))).otherwise(0.0))
        else:
            wanted = held.withColumn("wanted", F.when(F.col("held") > 0, F.pow("held", F.lit(TEMPERATURE))).otherwise(0.0))
        whole = wanted.agg(F.sum("wanted")).first()[0] or 1.0
        goals[axis] = durable(wanted.select(axis, (F.col("wanted") / whole).alias("goal")), "mix-goals")
    fitted = cells.withColumn("w", F.col("tokens") / max(total, 1e-300))
    for _ in range(STEPS):
        moved = fitted.withColumn("before", F.col("w"))
        for axis in AXES:
            held = moved.groupBy(axis).agg(F.sum("w").alias("sum")).join(goals[axis], axis)
            factor = held.select(axis, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            moved = moved.join(factor, axis).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        fitted = durable(moved, "mix-weights")
        change = fitted.agg(F.max(F.abs(F.col("w") - F.col("before")))).first()[0]
        fitted = fitted.drop("before")
        if (change or 0.0) < 1e-12:
            break
    # the cells that are taken whole are those with the least tokens for their weight
    open_, left, scale = fitted.filter("tokens > 0 and w > 0"), None, 0.0
    left = min(share * total, open_.agg(F.sum("tokens")).first()[0] or 0.0)
    while True:
        weight = open_.agg(F.sum("w")).first()[0]
        if not weight:
            break
        scale = left / weight
        full = F.col("w") * scale >= F.col("tokens")
        taken = open_.filter(full).agg(F.sum("tokens")).first()[0]
        if not taken:
            break
        left, open_ = left - taken, open_.filter(~full)
    p = F.when((F.col("tokens") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.col("w") * scale / F.col("tokens"))).otherwise(0.0)
    return fitted.select(*AXES, F.col("w").alias("cell_weight"), p.alias("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the doc_id alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE_KEPT) -> DataFrame:
    """Every row's cell, its weight and probability, and whether it is sampled."""
    cells = cells_of(docs)
    joined = cells.join(fit(cells, targets, share), list(AXES), "left")
    return joined.select(
        "doc_id", *AXES, "n_tokens", "cell_weight", "probability", (draw(F.col("doc_id")) < F.coalesce("probability", F.lit(0.0))).alias("sampled")
    )


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE_KEPT) -> DataFrame:
    """The sampled rows with their own columns alone; no row is moved."""
    fitted = fit(cells_of(docs), targets, share)
    none, own = F.lit("(none)"), docs.columns
    row = F.struct(*own).alias("row")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(row, F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), text.alias("t"))
    keyed = keyed.withColumn("topic", topic(F.col("t"), n_tokens(F.col("t")))).drop("t")
    drawn = keyed.join(fitted, list(AXES)).filter(draw(F.col("row.doc_id")) < F.col("probability"))
    return drawn.select("row.*")
