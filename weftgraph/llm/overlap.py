"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence with itself.

Rows are the distinct sets of n-grams (documents with one set are one row), columns are n-grams in the order of their hashes. A pair
links just if its overlap reaches t (a + b) / (100 + t), with sizes a and b and a threshold of t per cent; then neither size is under t
per cent of the other, and the overlap is t per cent of either at least.

A row's columns are cut into a lead block, its lowest n - ceil(t n / 100) + ceil(n / LEAD_PART) hashes, and the rest. Of a pair that
links, at most n - ceil(t n / 100) columns of either row are not shared, so in the two lead blocks ceil(n / LEAD_PART) of one of
the rows are shared at least. So the first product is over the lead blocks alone: columns with one row go, then rows with too few
columns left.

A column that many rows share (a notice, or the text of a group of copies) would make the product quadratic. So the product is
taken by lead rows, ROUNDS times one of each column, the row that stands with most others: overlaps are accumulated by (row, lead
row), pairs below their bound are discarded, and the others' overlaps are completed on the whole rows. Then lead rows leave
their columns, as do columns whose rows are one component. Where after that rows of several components still share columns, the
rest of the product is taken with the column's first lead row p subtracted: with D(x) = x xor p, |x xor y| = |D(x)| + |D(y)| - 2
|D(x) & D(y)|, where each D is short for rows like p and the columns that all share are gone. Two rows link just if

    2 (100 + t) |D(x) & D(y)| >= g(x) + g(y),   g(x) = (100 + t) |D(x)| - (100 - t) |x|.

A row that links with p has g <= (100 - t) |p|, any other has more; of two rows in different components one at least is of the
second kind. That product is blocked by g: rows near p are dealt by g into NEAR_BLOCKS, and a far row meets each block only in as many of
its rarest columns as the block's least g allows (one shared column at least stands there). A row whose D is so large that no row
that links with p can link with it is remote: it has a column in common with p and little else. Remote rows leave p and are
multiplied with each other, and with rows that don't link with p either, over the rarest of their own columns. What meets is
completed on the whole rows. Rows with fewer than t per cent of their columns in any other row left link with none and are left
out before. All of this is exact; only links that can't change a component are not looked for.

Columns are 64-bit hashes of n-grams of five words' 64-bit hashes. Defined cases: null and empty texts, or those without words, have no
n-gram and link with nothing. A text with fewer words than an n-gram is one n-gram. Rows with a null doc_id take no part and are
returned with a null component. A doc_id is one document: where it is repeated with other texts, it links with what any of them links with.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.minhash import _common, components, digests, full_sets, same_ids, shared_sizes, shingle_sets
from weftgraph.llm.store import drop, durable, releasing
from weftgraph.llm.words import slices

THRESHOLD = 80
LEAD_PART = 20
NEAR_BLOCKS = 8
#: So many lead rows of each column are multiplied out before the rest is subtracted; columns with one row more are done by then.
ROUNDS = 3


def spare(n: str) -> str:
    """SQL: lead columns that a linked pair shares at least, for a row of n columns."""
    return f"(({n} + {LEAD_PART - 1}) div {LEAD_PART})"


def rows_of(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, n, the digest of the row in two halves, and its lead block, for each document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, starts = shingle_sets(part.column(1).to_pylist())
            n = np.diff(starts)
            lead = n - (n * threshold + 99) // 100 + -(-n // LEAD_PART)
            ends = np.concatenate([[0], np.cumsum(lead)])
            at = np.repeat(starts[:-1] - ends[:-1], lead) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[at].view(np.int64)))
            columns = [part.column(0), pa.array(n, pa.int64()), *map(pa.array, digests(hashes, starts)), lists]
            yield pa.record_batch(columns, names=["doc_id", "n", "d1", "d2", "lead"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        build, "doc_id long, n long, d1 long, d2 long, lead array<long>"
    )


def completed(pairs: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, by the overlap of the whole rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep[k] = _common(x, y) * (100 + threshold) >= threshold * (len(x) + len(y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return _with_rows(pairs, rows).mapInArrow(count, "a long, b long")


def _with_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    for end in ("b", "a"):
        pairs = pairs.join(rows.select(F.col("v").alias(end), F.col("items").alias(f"of_{end}")), end)
    return pairs.select("a", "b", "of_a", "of_b")


def differences(pairs: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b, g, n_b, item): the columns of row a minus lead row b, with g and the lead row's size; nothing where both are equal."""

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items, g, n = [], [], []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                    items.append(np.setxor1d(x, y, assume_unique=True))
                    g.append((100 + threshold) * len(items[-1]) - (100 - threshold) * len(x))
                    n.append(len(y))
                sizes = [len(x) for x in items]
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [part.column(0).take(row), part.column(1).take(row)]
                columns += [pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in (g, n)]
                yield pa.record_batch([*columns, pa.array(np.concatenate(items))], names=["a", "b", "g", "n_b", "item"])

    return _with_rows(pairs, rows).mapInArrow(subtract, "a long, b long, g long, n_b long, item long")


def distances(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, d): how many columns rows a and b don't share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d[k] = len(x) + len(y) - 2 * _common(x, y)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"])

    return _with_rows(pairs, rows).mapInArrow(count, "a long, b long, d long")


def _sizes_fit(a: str, b: str, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def subtracted_product(members: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of members(p, v, n, c, core) that may link and are in different components c, by the product with lead rows p subtracted."""
    up, low = 100 + threshold, 100 - threshold
    apart = durable(differences(members.select(F.col("v").alias("a"), F.col("p").alias("b")), rows, threshold), "overlap-differences")
    often = apart.groupBy("b", "item").agg(F.count("*").alias("often")).filter("often > 1")
    held = apart.join(often, ["b", "item"]).groupBy("a", "b").agg(
        F.first("g").alias("g"), F.first("n_b").alias("n_b"), F.array_sort(F.collect_list(F.struct("often", "item"))).alias("held")
    )
    held = held.join(members.select(F.col("v").alias("a"), F.col("p").alias("b"), "n", "c", "core"), ["a", "b"])
    held = durable(held.withColumn("size", F.size("held")), "overlap-held")
    drop(apart)

    def prefix(of: DataFrame, least: Column, block: Column) -> DataFrame:
        need = F.greatest(F.lit(1), F.ceil((F.col("g") + least) / (2 * up)))
        kept = F.transform(F.slice("held", 1, F.greatest(F.lit(0), F.col("size") - need + 1).cast("int")), lambda x, k: F.struct(x["item"].alias("item"), (k + 1).alias("at")))
        row = F.struct("a", "n", "c", "core", "g", "size").alias("x")
        return of.select("b", block.alias("block"), row, F.explode(kept).alias("i")).select("b", "block", "x", "i.item", "i.at")

    reach = low * F.col("n_b")  # a near row's g is from -reach to reach
    far, width = F.col("g") > reach, 2 * reach / NEAR_BLOCKS
    block = F.least(F.lit(NEAR_BLOCKS - 1), F.floor((F.col("g") + reach) / width)).cast("int")
    near = prefix(held.filter(~far), reach + 1, block)
    outer = prefix(held.filter(far), reach + 1, F.lit(NEAR_BLOCKS))
    blocks = held.filter(far).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(NEAR_BLOCKS - 1))))
    probes = prefix(blocks, F.floor(F.col("block") * width - reach), F.col("block")).unionByName(outer)
    other = near.unionByName(outer).select("b", "block", "item", F.col("x").alias("y"), F.col("at").alias("at_y"))
    met = probes.join(other, ["b", "block", "item"])
    both = F.ceil((F.col("x.g") + F.col("y.g")) / (2 * up))
    common = F.least("x.core", "y.core")
    enough = common * up >= (F.col("x.n") + F.col("y.n")) * threshold
    enough &= (F.col("at") <= F.col("x.size") - both + 1) & (F.col("at_y") <= F.col("y.size") - both + 1)
    once = (F.col("block") < NEAR_BLOCKS) | (F.col("x.a") < F.col("y.a"))
    met = met.filter(once & (F.col("x.c") != F.col("y.c")) & enough & _sizes_fit("x.n", "y.n", threshold))
    return met.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def rarest_product(members: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of members(v, n, c, remote) that may link, one of them remote, and are in different components c, by the product over
    their rarest columns: of n columns any n - ceil(t n / 100) + 1 hold a shared one, and those that no other row has come first."""
    whole = rows.join(members.select("v").distinct(), "v", "left_semi")
    entries = durable(entries_of(whole), "overlap-entries")
    often = entries.groupBy("item").agg(F.count("*").alias("often")).filter("often > 1")
    held = entries.join(often, "item").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("held"))
    held = held.join(members, "v").withColumn("size", F.size("held")).withColumn("first", F.expr(f"size - (n * {threshold} + 99) div 100 + 1"))
    kept = F.transform(F.slice("held", 1, F.col("first").cast("int")), lambda x, k: F.struct(x["item"].alias("item"), k.alias("at")))
    cut = held.filter("first > 0").select(F.struct("v", "n", "c", "remote", "size").alias("x"), F.explode(kept).alias("i"))
    cut = durable(cut.select("x", "i.item", "i.at"), "overlap-rarest")
    drop(entries)
    met = cut.filter("x.remote").join(cut.select("item", F.col("x").alias("y"), F.col("at").alias("at_y")), "item")
    need = f"((x.n + y.n) * {threshold} + {99 + threshold}) div {100 + threshold}"
    left = F.least(F.col("x.size") - F.col("at"), F.col("y.size") - F.col("at_y")) >= F.expr(need)  # this column and all after it
    once = ~F.col("y.remote") | (F.col("x.v") < F.col("y.v"))
    met = met.filter(once & (F.col("x.c") != F.col("y.c")) & left & _sizes_fit("x.n", "y.n", threshold))
    return met.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


def entries_of(rows: DataFrame) -> DataFrame:
    """(v, item) of rows(v, items)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                owner = part.column(0).take(pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items])))
                yield pa.record_batch([owner, pa.array(np.concatenate(items))], names=["v", "item"])

    return rows.select("v", "items").mapInArrow(explode, "v long, item long")


def leading(entries: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of entries(item, v, n, c, degree): each column's lead row (item, p, p_n), and the pairs (a, b) of a row and a lead row whose overlap
    in the entries may reach their bound. An overlap is known in the columns that the lead row leads; it has few others."""
    by_item = entries.groupBy("item").agg(F.count("*").alias("often"), F.max_by(F.struct("v", "n", "c"), F.struct("degree", -F.col("v"))).alias("p"))
    leaders = durable(by_item.filter("often > 1").select("item", F.col("p.v").alias("p"), F.col("p.n").alias("p_n"), F.col("p.c").alias("p_c")), "overlap-leaders")
    own = entries.groupBy("v").agg(F.count("*").alias("own"))
    led = leaders.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("led"))
    other = led.join(own, "v").select(F.col("v").alias("p"), (F.col("own") - F.col("led")).alias("other"))
    met = entries.join(leaders, "item").filter((F.col("c") != F.col("p_c")) & _sizes_fit("n", "p_n", threshold))
    counted = met.groupBy("v", "n", "p", "p_n").agg(F.count("*").alias("so_far")).join(other, "p")
    need = f"(({threshold} * (n + p_n) + {99 + threshold}) div {100 + threshold})"
    bounds = [f"{need} - ({x} * {threshold} + 99) div 100 + {spare(x)}" for x in ("n", "p_n")]
    pairs = counted.filter(f"so_far + other >= least({bounds[0]}, {bounds[1]})").select(F.col("v").alias("a"), F.col("p").alias("b"))
    return leaders, durable(pairs, "overlap-pairs")


def linked_rows(classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """(v, c): components of the classes (v, rep, n, d1, d2, lead) of distinct sets; those without a link are absent."""
    entries = classes.select("v", "n", F.explode("lead").alias("item"))
    shared = entries.groupBy("item").agg(F.count("*").alias("often")).filter("often > 1")
    with releasing(docs.sparkSession):
        held = durable(entries.join(shared, "item"), "overlap-lead")
    some = held.groupBy("v", "n").agg(F.count("*").alias("own"), F.sum("often").alias("degree"))
    some = some.filter(f"own >= {spare('n')}").select("v", "degree")
    entries = durable(held.join(some, "v").select("item", "v", "n", F.col("v").alias("c"), "degree", F.lit(None).cast("long").alias("first")), "overlap-lead")
    drop(held)
    members = entries.select("v").distinct().join(classes.select("v", "rep", "d1", "d2"), "v")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep").distinct(), "rep", "left_semi")
    rows = full_sets(texts).join(members.select("v", "d1", "d2"), ["d1", "d2"])
    with releasing(docs.sparkSession):
        rows = durable(rows.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.first("items").alias("items")).select("v", "items"), "overlap-rows")
    links, comp, later = None, None, False
    for _ in range(ROUNDS):
        leaders, pairs = leading(entries, threshold)
        found = durable(completed(pairs, rows, threshold), "overlap-links")
        links = found if links is None else links.unionByName(found)
        if comp is None:
            comp = components(links)
        else:  # what later rounds find is joined to components at their end
            later = later or not found.isEmpty()
        # a lead row has met all rows of its column; of two linked rows that never met, all common columns are left, and all are mixed
        left = entries.drop("c").join(leaders.select("item", "p"), "item").filter("v <> p").join(comp, "v", "left")
        left = durable(left.select("item", "v", "n", F.coalesce("c", "v").alias("c"), "degree", F.coalesce("first", "p").alias("first")), "overlap-left")
        mixed = left.groupBy("item").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("item")
        still = left.join(mixed, "item")
        enough = still.groupBy("v", "n").agg(F.count("*").alias("own")).filter(f"own >= {spare('n')}").select("v")
        before, entries = entries, durable(still.join(enough, "v").select("item", "v", "n", "c", "degree", "first"), "overlap-lead")
        for gone in (before, left, leaders, pairs):
            drop(gone)
        if entries.isEmpty():
            break
    if later:
        comp = components(links)
    still = entries.select(F.col("first").alias("p"), "v", "n").distinct().join(comp, "v", "left")
    still = durable(still.select("p", "v", "n", F.coalesce("c", "v").alias("c")), "overlap-open")
    if still.isEmpty():
        return comp
    cores = shared_sizes(rows.join(still.select("v").distinct(), "v", "left_semi"))
    left = still.join(cores, "v").filter(F.col("core") * 100 >= F.col("n") * threshold)
    left = durable(left, "overlap-members")
    apart = distances(left.select(F.col("v").alias("a"), F.col("p").alias("b")), rows)
    kinds = left.join(apart.select(F.col("a").alias("v"), F.col("b").alias("p"), "d"), ["v", "p"])
    kinds = kinds.join(classes.select(F.col("v").alias("p"), F.col("n").alias("n_p")), "p")
    # the most that a row can differ from p and still link with one that links with p
    most = F.least("n", "n_p") * (200 / threshold) + F.col("n") + F.col("n_p")
    kinds = durable(kinds.withColumn("remote", F.col("d") * (100 + threshold) > most * (100 - threshold)), "overlap-kinds")
    several = lambda of: of.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("p")
    close = kinds.filter("not remote")
    close = durable(close.join(several(close), "p").select("p", "v", "n", "c", "core"), "overlap-close")
    links_with_p = F.col("d") * (100 + threshold) <= (F.col("n") + F.col("n_p")) * (100 - threshold)
    outer = kinds.filter(~links_with_p)
    outer = outer.join(several(outer), "p").groupBy("v", "n", "c").agg(F.bool_or("remote").alias("remote"))
    outer = durable(outer, "overlap-outer")
    pairs = [rarest_product(outer, rows, threshold)] if not outer.filter("remote").isEmpty() else []
    if not close.isEmpty():
        pairs.append(subtracted_product(close, rows, threshold))
    if not pairs:
        return comp
    found = durable(completed(reduce(DataFrame.unionByName, pairs).distinct(), rows, threshold), "overlap-links")
    return comp if found.isEmpty() else components(links.unionByName(found))


def join_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for every row."""
    signed = durable(rows_of(docs, threshold), "overlap-rows")
    known = signed.filter("doc_id is not null and n > 0")
    classes = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("lead").alias("lead"))
    classes = durable(classes.withColumn("v", F.monotonically_increasing_id()), "overlap-classes")  # numbers hold as they are written
    lean = durable(signed.drop("lead"), "overlap-documents")
    drop(signed)
    signed = lean
    comp = linked_rows(classes, docs, threshold)
    repeated = durable(same_ids(signed.filter("doc_id is not null and n > 0"), classes), "overlap-links")
    if not repeated.isEmpty():
        linked = comp.filter("c < v").select(F.col("c").alias("a"), F.col("v").alias("b"))
        comp = components(linked.unionByName(repeated))
    linked = comp.join(classes.select("v", "rep"), "v")
    least = linked.join(linked.groupBy("c").agg(F.min("rep").alias("component")), "c").select("v", "component")
    least = classes.select("v", "rep", "n", "d1", "d2").join(least, "v", "left")
    least = least.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = signed.join(least, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), s AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END) AS g FROM w
), n AS (
    SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON doc_id = a GROUP BY doc_id, n
"""
