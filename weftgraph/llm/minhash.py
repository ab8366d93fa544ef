"""Near-duplicate documents: fast similarity sketches, banding, and verification on the full shingle sets.

A sketch has T coordinates. In round i every shingle is hashed to one coordinate, with a value in [i, i+1); a
coordinate keeps its least value, and rounds go on until all are filled. From round T on, round i puts every shingle
into coordinate i - T, so all are filled after 2T rounds at most. Two sketches agree in a coordinate with a
probability of the sets' similarity, and the number of agreements is concentrated about its mean. Coordinates are cut
into bands; documents that agree in a whole band are candidates, at BANDS x ROWS as below with a chance of 5 in
a million to miss a pair that is exactly at the threshold of 0.75. A candidate counts only if the full sets say so.

Documents with one set are one class and are handled as one. Within a band's bucket, members are first compared with a
pivot only, the member that shares most buckets with others, which is the centre of a group of copies. Where a bucket then
still holds members of several components, its members are joined by what sets them apart from the pivot. With p the pivot,
D(x) = x xor p, and J(x, y) >= 3/4 just if |D(x) xor D(y)| <= (|x| + |y|) / 7. So with g(x) = 7 |D(x)| - |x| two members are
linked just if their differences have (g(x) + g(y)) / 14 shingles in common. A member that is linked with p has g <= |p|, any
other has more, and of two members that are not in one component at least one is of the second kind. Items that stand in
one difference only can't be common; the others are taken from the rarest on, only as many as leave too few behind (a prefix
filter), and members that share such an item are compared. All of this is exact, and as copies differ in places of
their own, it leaves few pairs even in large groups. Members with under 3/4 of their shingles in any other open member are
linked with none and left out before.

A pair is compared on the full sets only if both sizes allow the threshold and the sketches do: of each coordinate two bits
are kept, and pairs at the threshold agree in 104 of 128 on average, with a deviation of 4.4; pairs with fewer than
LEAST_AGREEING, 6 deviations less, are left out, which loses one true link in a billion. Sets are of 64-bit hashes of the
shingles, of words' 64-bit hashes.

Defined cases: null and empty texts, or those without words, have an empty set, are linked with nothing and are kept.
A text with fewer words than a shingle is one shingle. Rows with a null doc_id take no part and are returned with a
null component, kept. A doc_id is one document: where it is repeated with other texts, it is linked with what any of them is
linked with. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.store import durable, drop
from weftgraph.llm.words import flat_hashes, grams, inside, mix, slices, split_lower

SHINGLE = 5
THRESHOLD = 75  # per cent of the union
BANDS, ROWS = 32, 4
T = BANDS * ROWS
NEAR_BANDS = 8  # members linked with a pivot are dealt by g into so many bands, for shorter prefixes
LEAST_AGREEING = 78
SKETCH = ("s0", "s1", "s2", "s3")
_all = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts, sorted within each text, and where each text's begin."""
    parts = [split_lower(t) for t in texts]
    flat, starts = flat_hashes(parts)
    hashes = grams(flat, size)
    ok = inside(starts, size, len(hashes))
    owner = np.repeat(np.arange(len(parts)), np.diff(starts))[: len(hashes)]
    hashes, owner = hashes[ok], owner[ok]
    short = [k for k in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < size))]
    if short:
        whole = [grams(flat[starts[k] : starts[k + 1]], int(starts[k + 1] - starts[k])) for k in short]
        hashes, owner = np.concatenate([hashes, *whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(parts) + 1))


def sketches(hashes: np.ndarray, starts: np.ndarray, t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; those of empty sets stay at the largest value."""
    n = len(starts) - 1
    out = np.full((n, t), _all)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(starts))
    active, values = owner, hashes
    for i in range(2 * t):
        if not len(active):
            break
        h = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = (h % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, active * t + place, np.uint64(i << 56) | (h >> np.uint64(8)))
        open_ = (out == _all).any(axis=1)
        if not open_[active].all():
            stay = open_[active]
            active, values = active[stay], values[stay]
    return out


def band_keys(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, t = rows.shape
    parts = rows.reshape(n, bands, t // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(t // bands):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def short_sketches(rows: np.ndarray) -> list[np.ndarray]:
    """Two bits of each coordinate, packed in len(SKETCH) numbers."""
    two = (rows & np.uint64(3)).reshape(len(rows), len(SKETCH), -1)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return [np.bitwise_or.reduce(two[:, k] << shifts, axis=1).view(np.int64) for k in range(len(SKETCH))]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])  # modulo 2**64
    return (total[starts[1:]] - total[starts[:-1]]).view(np.int64)


def digests(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set, which tell sets apart."""
    return _sums(mix(hashes), starts), _sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the set in two halves, and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, starts = shingle_sets(part.column(1).to_pylist())
            rows = sketches(hashes, starts)
            keys = band_keys(rows)
            flat = pa.array(np.ascontiguousarray(keys).reshape(-1), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, BANDS), pa.int32()), flat)
            columns = [
                part.column(0),
                pa.array(np.diff(starts), pa.int64()),
                *map(pa.array, digests(hashes, starts)),
                lists,
                *map(pa.array, short_sketches(rows)),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n", "d1", "d2", "bands", *SKETCH])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """The digests of the texts' sets, and the sets as sorted 64-bit hashes in binary; equal sets may be repeated."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, starts = shingle_sets(part.column(0).to_pylist())
            d1, d2 = digests(hashes, starts)
            once = np.unique(d1, return_index=True)[1]  # repeated texts make one set
            packed = [hashes[starts[k] : starts[k + 1]].tobytes() for k in once.tolist()]
            yield pa.record_batch([pa.array(d1[once]), pa.array(d2[once]), pa.array(packed, pa.binary())], names=["d1", "d2", "items"])

    return docs.select("text").mapInArrow(build, "d1 long, d2 long, items binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with of_a and of_b, the sets of a and b."""
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("v").alias(end), F.col("items").alias(f"of_{end}")), end)
    return pairs


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(x, y)
                keep[k] = 100 * common >= THRESHOLD * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return _with_sets(pairs, sets).select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, g, n_b, item): what sets a apart from its pivot b, with g = 7 |D| - |a| and the pivot's size; nothing where both are equal."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                items, g, n = [], [], []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                    items.append(np.setxor1d(x, y, assume_unique=True))
                    g.append(7 * len(items[-1]) - len(x))
                    n.append(len(y))
                sizes = [len(x) for x in items]
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [part.column(0).take(row), part.column(1).take(row)]
                columns += [pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in (g, n)]
                yield pa.record_batch([*columns, pa.array(np.concatenate(items))], names=["a", "b", "g", "n_b", "item"])

    rows = _with_sets(pairs, sets).select("a", "b", "of_a", "of_b")
    return rows.mapInArrow(differ, "a long, b long, g long, n_b long, item long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for every vertex of edges(a, b) the least vertex it can reach.

    Every vertex takes the least label of its neighbours, chains of labels are shortened by looking up labels of
    labels, and the edges are contracted to labels, until none is left between two labels.
    """
    left = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not left.isEmpty():
        edges_before, labels_before = left, labels
        # b > a always, so each b takes its least a; an a keeps its label unless it is also a b
        hop = left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c"))
        hop = first = durable(hop, "cc-hop")
        for _ in range(4):
            up = hop.select(F.col("v").alias("c"), F.col("c").alias("up"))
            hop = hop.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
        hop = durable(hop, "cc-hop")
        if labels is None:
            roots = left.select(F.explode(F.array("a", "b")).alias("v")).distinct()
            labels = roots.join(hop, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
        else:
            step = hop.select(F.col("v").alias("c"), F.col("c").alias("up"))
            labels = labels.join(step, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
        labels = durable(labels, "cc-labels")
        for end in ("a", "b"):
            to = hop.select(F.col("v").alias(end), F.col("c").alias("to"))
            left = left.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = durable(left.filter("a <> b").distinct(), "cc-edges")
        for gone in (first, hop, labels_before, edges_before):  # nothing refers to them any more
            if gone is not None:
                drop(gone)
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).limit(0)
    return labels


def _fits(a: str, b: str) -> Column:
    """Whether two members, given as structs of n and the short sketch, can reach the threshold."""
    sizes = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * 100 >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * THRESHOLD
    differ = F.lit(0)
    for c in SKETCH:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return sizes & (differ <= T - LEAST_AGREEING)


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(v, core): how many shingles of each set stand in another of the sets, too."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            if parts:
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts])))
                yield pa.record_batch([ids, pa.array(np.concatenate(parts))], names=["v", "item"])

    rows = sets.select("v", "items").mapInArrow(items, "v long, item long")
    common = rows.groupBy("item").agg(F.count("*").alias("sets")).filter("sets > 1").select("item")
    return rows.join(common, "item").groupBy("v").agg(F.count("*").alias("core"))


def open_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of members(p, m, c, core) that may be linked and are not in one component c, by the differences from pivots p."""
    apart = durable(differences(members.select(F.col("m.v").alias("a"), F.col("p").alias("b")), sets), "minhash-differences")
    often = apart.groupBy("b", "item").agg(F.count("*").alias("n")).filter("n > 1")
    held = apart.join(often, ["b", "item"]).groupBy("a", "b").agg(
        F.first("g").alias("g"), F.first("n_b").alias("n_b"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("held")
    )
    held = held.join(members.select(F.col("m.v").alias("a"), F.col("p").alias("b"), "m", "c", "core"), ["a", "b"])
    held = durable(held.withColumn("size", F.size("held")), "minhash-held")
    need = lambda least: F.greatest(F.lit(1), F.ceil((F.col("g") + least) / 14))  # noqa: E731  common items, given the other's least g

    def prefix(of: DataFrame, least: Column, band: Column) -> DataFrame:
        kept = F.transform(F.slice("held", 1, F.greatest(F.lit(0), F.col("size") - need(least) + 1).cast("int")), lambda x, k: F.struct(x["item"].alias("item"), (k + 1).alias("at")))
        return of.select("b", band.alias("band"), F.struct("m", "c", "core", "g", "size").alias("x"), F.explode(kept).alias("i")).select("b", "band", "x", "i.item", "i.at")

    width, far = F.col("n_b") / (NEAR_BANDS / 2), F.col("g") > F.col("n_b")  # a near member's g is from -n_b to n_b
    band = F.least(F.lit(NEAR_BANDS - 1), F.floor((F.col("g") + F.col("n_b")) / width)).cast("int")
    beyond = F.col("n_b") + 1
    near = prefix(held.filter(~far), beyond, band)
    outer = prefix(held.filter(far), beyond, F.lit(NEAR_BANDS))
    bands = held.filter(far).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(NEAR_BANDS - 1))))
    probes = prefix(bands, F.floor(F.col("band") * width - F.col("n_b")), F.col("band")).unionByName(outer)
    other = near.unionByName(outer).select("b", "band", "item", F.col("x").alias("y"), F.col("at").alias("at_y"))
    met = probes.join(other, ["b", "band", "item"])
    both = F.ceil((F.col("x.g") + F.col("y.g")) / 14)
    common = F.least("x.core", "y.core")
    enough = common * 100 >= (F.col("x.m.n") + F.col("y.m.n") - common) * THRESHOLD
    enough &= (F.col("at") <= F.col("x.size") - both + 1) & (F.col("at_y") <= F.col("y.size") - both + 1)
    once = (F.col("band") < NEAR_BANDS) | (F.col("x.m.v") < F.col("y.m.v"))
    met = met.filter(once & (F.col("x.c") != F.col("y.c")) & enough & _fits("x.m", "y.m"))
    return met.select(F.least("x.m.v", "y.m.v").alias("a"), F.greatest("x.m.v", "y.m.v").alias("b")).distinct()


def link_components(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, c): components of the classes (v, rep, d1, d2, n, bands, short sketch) of distinct sets; those without a link are absent."""
    keyed = classes.select(F.explode("bands").alias("key"), F.struct("v", "n", *SKETCH).alias("m"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = durable(keyed.join(shared, "key"), "minhash-buckets")
    degrees = buckets.groupBy(F.col("m.v").alias("v")).agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degrees, buckets["m.v"] == degrees["v"]).select("key", "m", "degree")
    pivots = durable(ranked.groupBy("key").agg(F.max_by("m", F.struct("degree", -F.col("m.v"))).alias("p")), "minhash-pivots")
    to_pivot = buckets.join(pivots, "key").filter((F.col("m.v") != F.col("p.v")) & _fits("m", "p"))
    pairs = durable(to_pivot.select(F.col("m.v").alias("a"), F.col("p.v").alias("b")).distinct(), "minhash-pairs")
    # one text of each class in a bucket: that of the least doc_id, told from others under the same doc_id by its digest
    members = degrees.select("v").join(classes.select("v", "rep", "d1", "d2"), "v")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = full_sets(texts).join(members.select("v", "d1", "d2"), ["d1", "d2"])
    sets = durable(sets.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.first("items").alias("items")).select("v", "items"), "minhash-sets")
    links = durable(verified(pairs, sets), "minhash-links")
    comp = components(links)
    labelled = buckets.select("key", "m", F.col("m.v").alias("v")).join(comp, "v", "left").select("key", "m", F.coalesce("c", "v").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    still = labelled.join(mixed, "key").join(pivots.select("key", F.col("p.v").alias("p")), "key")
    still = durable(still.select("p", F.col("m.v").alias("v"), "m", "c").dropDuplicates(["p", "v"]), "minhash-open")
    if still.isEmpty():
        return comp
    # what two members have in common is at most what each has in common with any of those left
    cores = shared_sizes(sets.join(still.select("v").distinct(), "v", "left_semi"))
    some = still.join(cores, "v").filter(F.col("core") * 100 >= F.col("m.n") * THRESHOLD)
    several = some.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("p")
    members = durable(some.join(several, "p").select("p", "m", "c", "core"), "minhash-members")
    if members.isEmpty():
        return comp
    found = durable(verified(open_pairs(members, sets), sets), "minhash-links")
    return comp if found.isEmpty() else components(links.unionByName(found))


def same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of a doc_id that is repeated with other texts."""
    several = signed.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo < hi").select("doc_id")
    named = signed.join(several, "doc_id").select("doc_id", "n", "d1", "d2").distinct()
    named = durable(named.join(classes.select("v", "n", "d1", "d2"), ["n", "d1", "d2"]).select("doc_id", "v"), "minhash-repeated")
    first = named.groupBy("doc_id").agg(F.min("v").alias("a"))
    return named.join(first, "doc_id").select("a", F.col("v").alias("b")).filter("a < b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = durable(signatures(docs), "minhash-signatures")
    known = signed.filter("doc_id is not null and n > 0")
    classes = known.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "bands", *SKETCH)).alias("r"))
    classes = classes.select("n", "d1", "d2", F.col("r.doc_id").alias("rep"), "r.bands", *(f"r.{c}" for c in SKETCH))
    classes = durable(classes.withColumn("v", F.monotonically_increasing_id()), "minhash-classes")  # numbers hold as they are written
    comp = link_components(classes, docs)
    repeated = durable(same_ids(known, classes), "minhash-links")
    if not repeated.isEmpty():
        linked = comp.filter("c < v").select(F.col("c").alias("a"), F.col("v").alias("b"))
        comp = components(linked.unionByName(repeated))
    linked = comp.join(classes.select("v", "rep"), "v")
    least = linked.join(linked.groupBy("c").agg(F.min("rep").alias("component")), "c").select("v", "component")
    least = classes.select("v", "rep", "n", "d1", "d2").join(least, "v", "left")
    least = least.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("doc_id", "n", "d1", "d2").join(least, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
