"""N-gram Jaccard join: pivots, regions around them, and an exact recursive join inside the regions.

Jaccard distance is a metric, but documents that share nothing are all at distance 1 from each other, so that pivots
drawn at random put nearly every document inside every triangle-inequality window. Pivots are therefore chosen where documents are
known to lie close: a set of n shingles is cut by hash range into more parts than its partners can differ in, so two linked
documents agree on a whole part. Documents with an equal part form a cell whose smallest node is its pivot, and a document belongs to the
regions of the pivots of its cells (boundary documents to several). All linked pairs meet in a region.

A region's join is exact: distances to the pivot are computed; documents within the threshold of the pivot are linked to
it; others are compared with the documents whose distance to the pivot differs by no more than the threshold (the triangle
inequality), through the places where they differ from the pivot.

Many documents share a part and little else (a passage, a notice). Before a text moves, a region is therefore looked at by sketches: a
set's shingles are dealt into some two buckets each, and of each bucket one bit tells whether it holds an odd number. Buckets in which
two sketches differ are no more than the shingles in which the sets differ, so members whose sketches are too far
from all others are linked with none in the region, and their texts stay where they are.

A region too large for a task gets further pivots, and each document is assigned to the nearest (a Voronoi cell). Documents that
are not linked to the region's own pivot are open: they look for partners in their own cell, to which documents
of other cells are replicated if they lie within twice the threshold of the boundary. A cell is cut into rings of
distance to its pivot, so that partners are one ring apart at most, and rings into blocks by hash, so that no task takes more
than its bound, however large or dense a region is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.arrays import mix, row_chunks, shingle_sets, utf8
from reelgrid.llm.components import components
from reelgrid.session import written

#: Documents that a task joins at most, and shingles for each of them, before a region is split; pivots of a split region.
REGION = 4_000
SHINGLES = 500
PIVOTS = 4
#: A band of sizes reaches from 10 * BAND^b to 10 * BAND^(b+1) shingles.
BAND = 1.6
#: One row in SAMPLE is looked at for hot cells; a cell is hot with one in HOT of the rows seen.
SAMPLE = 64
HOT = 10_000
#: Hashes of placed texts that are broadcast at most (16 bytes each).
MAX_KEYS = 2_000_000

_U = np.uint64


def _band(n: float) -> int:
    b = -1 if n < 10 else int(np.log(n / 10) / np.log(BAND))
    while n >= _top(b):
        b += 1
    return b


def _top(b: int) -> float:
    return 10 * BAND ** (b + 1)


def parts_of(shingles: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Hashes of the set's first parts that hold a shingle, for its own band and for the next if partners can lie there.

    Sets of n and m shingles with den * intersection >= num * union differ in at most (n + m) * (den - num) / (den + num) shingles, so in at
    most as many parts. With k that bound for the largest partner in the band, a set gives its first k + 1 filled parts, in the order of the
    parts. Of two partners, let A be the one whose last given part comes first: one of its k + 1 parts is equal in B, and B gives it too, as B's
    parts reach as far. A set with k filled parts or fewer gives all parts, empty ones included: every part that a partner gives, and, of two such
    sets, more parts than they differ in. Parts are cut so that this is rare.
    """
    n = len(shingles)
    out = []
    first, last = _band(n), _band(n * den / num + 1e-9)
    for b in range(first, last + 1):
        differ = int(2 * (np.ceil(_top(b)) - 1) * (den - num) / (den + num) + 1e-9)
        parts = int(1.2 * (differ + 1)) + 8 if differ else 1
        which = ((shingles >> _U(32)) * _U(parts)) >> _U(32)
        cut = np.searchsorted(which, np.arange(parts + 1, dtype=np.uint64))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles + _U(0x632BE59BD9B4E019)))))
            found = mix(sums[cut[1:]] - sums[cut[:-1]] + mix(np.arange(parts, dtype=np.uint64) + _U((b + 2) << 32)))
        filled = cut[1:] > cut[:-1]
        k = (n + min(n * den // num, int(np.ceil(_top(b))) - 1)) * (den - num) // (den + num)
        out.append(found[filled][: k + 1] if filled.sum() > k else found)
    return out


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(shingles + _U(1)).sum(dtype=np.uint64), mix(shingles ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    n = np.array([len(shingles)], np.uint64)
    return int(mix(n + a).view(np.int64)[0]), int(mix(n ^ b).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """One bit a bucket: whether it holds an odd number of the set's shingles. Half as many buckets are the two halves' exclusive or."""
    bits = max(64, 1 << (3 * len(shingles) // 2).bit_length())
    held = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(bool), bitorder="little").tobytes()


def may_link(sketches: list[bytes], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets may be linked with another one, by a bound that no link escapes: sketches differ in no more buckets than the sets do in shingles."""
    widths = np.array([len(s) for s in sketches])
    out = np.zeros(len(sketches), bool)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        wider = np.flatnonzero(widths > width)
        wider = wider[den * sizes[own].max() >= num * sizes[wider]]
        rows = [np.frombuffer(sketches[i], np.uint64) for i in own.tolist()]
        for i in wider.tolist():
            bits = np.frombuffer(sketches[i], np.uint64)
            while len(bits) * 8 > width:
                bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
            rows.append(bits)
        bits, members = np.stack(rows), np.concatenate((own, wider))
        n = sizes[members]
        step = max(1, (1 << 22) // (width * len(members)))
        for i in range(0, len(own), step):
            a = n[i : min(i + step, len(own)), None]
            apart = np.bitwise_count(bits[i : i + len(a), None] ^ bits[None]).sum(axis=2, dtype=np.int64)
            near = ((num + den) * apart <= (den - num) * (a + n)) & (den * np.minimum(a, n) >= num * np.maximum(a, n))
            near[np.arange(len(a)), i + np.arange(len(a))] = False  # itself
            out[members[near.any(axis=0)]] = True
            out[members[i : i + len(a)][near.any(axis=1)]] = True
    return out


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    offsets, data = utf8(column)
    for i, j in row_chunks(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * inter >= num * (a + b - inter)


def local_links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Component of each set (index of a member), exactly; and the size of each set's intersection with the first, the pivot."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    pivot = sets[0]
    inside = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    shared = np.bincount(owner[inside], minlength=n)
    root = np.arange(n)
    near = linked(shared, sizes, sizes[0], num, den)
    root[near] = 0
    far = np.flatnonzero(~near)
    if not len(far):
        return root, shared
    # Differences from the pivot: |A ^ B| = |dA ^ dB|; whichever form is smaller is searched.
    apart = sizes + sizes[0] - 2 * shared
    by_difference = apart.sum() < sizes.sum()
    forms = [np.setxor1d(s, pivot, assume_unique=True) for s in sets] if by_difference else sets
    lengths = np.array([len(f) for f in forms], np.int64)
    values = np.concatenate(forms)
    order = np.argsort(values, kind="stable")
    values, members = values[order], np.repeat(np.arange(n), lengths)[order]
    distance = apart / np.maximum(1, sizes + sizes[0] - shared)
    width = 1 - num / den + 1e-9

    for i in far.tolist():
        at = _found(values, forms[i])
        at = at[np.abs(distance[members[at]] - distance[i]) <= width]  # the window goes before the intersections
        common = np.bincount(members[at], minlength=n)
        inter = (sizes[i] + sizes - (lengths[i] + lengths - 2 * common)) // 2 if by_difference else common
        others = np.flatnonzero(linked(inter, sizes[i], sizes, num, den) & (np.abs(distance - distance[i]) <= width))
        _unite(root, i, others)
    return np.array([_top_of(root, i) for i in range(n)]), shared


def _found(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of all occurrences of the wanted values in the sorted `values`."""
    low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    count = high - low
    return np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _top_of(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _unite(root: np.ndarray, i: int, others: np.ndarray) -> None:
    for j in others.tolist():
        x, y = _top_of(root, i), _top_of(root, j)
        if x != y:
            root[max(x, y)] = min(x, y)


def open_links(sets: list[np.ndarray], some: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component of each set by the links that have one of `some` (indices) at an end, exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, members = values[order], np.repeat(np.arange(n), sizes)[order]
    root = np.arange(n)
    for i in some.tolist():
        inter = np.bincount(members[_found(values, sets[i])], minlength=n)
        _unite(root, i, np.flatnonzero(linked(inter, sizes[i], sizes, num, den)))
    return np.array([_top_of(root, i) for i in range(n)])


def _join_block(size: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        opened = np.isin(nodes, table.filter(table.column("open")).column("node").to_numpy())
        sets = list(_sets(table.column("text").combine_chunks().take(pa.array(first)), size))
        root = open_links(sets, np.flatnonzero(opened), num, den)
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[at]), "b": pa.array(nodes[root[at]])})

    return run


def _join_region(size: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table.column("node").to_numpy()
        root, _ = local_links(list(_sets(table.column("text").combine_chunks(), size)), num, den)
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[at]), "b": pa.array(nodes[root[at]])})

    return run


def _likely(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        found = may_link(table.column("sketch").to_pylist(), table.column("n").to_numpy(), num, den) if len(nodes) > 1 else np.zeros(1, bool)
        return table.select(["region", "node", "k1", "k2"]).filter(pa.array(found))

    return run


def _pair(a: np.ndarray, b: np.ndarray, *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=list(names))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part and node: each later node of a part with the part's first, which is its pivot."""
    part = pivot = None
    for batch in batches:
        parts, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(parts):
            continue
        starts = np.concatenate(([True], parts[1:] != parts[:-1]))
        starts[0] = part is None or parts[0] != part
        at = np.flatnonzero(starts)
        first = np.full(len(parts), 0 if pivot is None else pivot)
        if len(at):
            first[at[0] :] = nodes[at][np.cumsum(starts[at[0] :]) - 1]
        part, pivot = int(parts[-1]), int(first[-1])
        keep = first != nodes
        yield _pair(first[keep], nodes[keep], "a", "b")


def _regions(parts: DataFrame, sample: DataFrame) -> DataFrame:
    """Distinct (pivot, node) over all cells of two or more nodes, pivots with themselves included.

    Cells are sorted and streamed in constant memory after one shuffle. Cells that hold over one in HOT of a sample's rows (HOT of them at most)
    are not shuffled: their pivots are partial aggregates, which are broadcast. The sample decides on the way only, not on the result.
    """
    counts = written(sample.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sampled")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(50, -(-total // HOT))).select("part")
    rest = parts
    if hot.limit(1).count():
        pivots = F.broadcast(written(parts.join(F.broadcast(hot), "part").groupBy("part").agg(F.min("node").alias("pivot")), "pivots"))
        rest = parts.join(F.broadcast(hot), "part", "left_anti")
    cells = rest.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_first_of_each, "a long, b long")
    if rest is not parts:
        cells = cells.unionByName(parts.join(pivots, "part").where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    cells = cells.distinct()
    return cells.select(F.col("a").alias("pivot"), F.explode(F.array("a", "b")).alias("node")).distinct()


def _uncovered(regions: DataFrame) -> DataFrame:
    """The regions but for those whose members all lie in another one, that of the smallest pivot which holds their own pivot; pairs meet there."""
    low = regions.groupBy(F.col("node").alias("pivot")).agg(F.min("pivot").alias("low")).where("low < pivot")
    held = regions.select(F.col("pivot").alias("low"), "node", F.lit(1).alias("held"))
    checked = regions.join(low, "pivot").join(held, ["low", "node"], "left")
    covered = checked.groupBy("pivot").agg(F.count(F.lit(1)).alias("all"), F.count("held").alias("in")).where("all = in").select("pivot")
    return regions.join(covered, "pivot", "left_anti")


def near_duplicates(df: DataFrame, *, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs of non-blank characters after lower-casing A-Z; a row's set holds its distinct `shingle`-word
    shingles, or its whole sequence if shorter. Rows link when den * intersection >= num * union. Null, empty and wordless texts have no
    set and are linked with nothing; equal sets are one node, so that copies cost no pairs; rows that repeat an id with other texts are rows of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("k2"))
    kind = df.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *set_hashes(s), sketch(s)) for s in _sets(batch.column(3), shingle)]  # the second hash tells sets apart that share the first
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "k1", "k2", "n", "node", "check", "sketch"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that a task meets again add nothing
        for batch in batches:
            parts, nodes, total = [], [], 0
            for s in _sets(batch.column(0), shingle):
                if not len(s) or (node := named(*set_hashes(s))) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                for p in parts_of(s, num, den):
                    parts.append(p.view(np.int64))
                    nodes.append(np.full(len(p), node))
                    total += len(p)
                if total > 100_000:
                    yield _pair(np.concatenate(parts), np.concatenate(nodes), "part", "node")
                    parts, nodes, total = [], [], 0
            if parts:
                yield _pair(np.concatenate(parts), np.concatenate(nodes), "part", "node")

    rows = written(docs.select("id", "k1", "k2", "text").mapInArrow(measure, f"id {kind}, k1 long, k2 long, n long, node long, check long, sketch binary"), "sets")
    # Sets with one 64-bit hash but two others are named by the second: about one pair in 10^19 collides, so these are a handful at any size.
    clash = [r["node"] for r in rows.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node").collect()]
    clashing = frozenset(clash)
    named = lambda node, check: check if node in clashing else node
    if clash:
        rows = rows.withColumn("node", F.when(F.col("node").isin(clash), F.col("check")).otherwise(F.col("node")))
    signed = lambda some: some.select("text").mapInArrow(sign, "part long, node long")
    cells = written(_regions(signed(docs), signed(docs.where(F.pmod("k1", F.lit(SAMPLE)) == 0))), "cells")
    regions = written(_uncovered(cells), "regions")
    lying = rows.where("n > 0").join(regions.select("node").distinct(), "node", "left_semi")
    places = lying.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("at"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    placed = written(regions.join(places, "node").select(F.col("pivot").alias("region"), "node", "at.k1", "at.k2", "n", "sketch"), "placed")
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    large = written(sizes.where((F.col("m") > region) | ((F.col("w") > region * SHINGLES) & (F.col("m") > 2))).select("region"), "large")
    some_large = large.limit(1).count() > 0
    small = placed.join(large, "region", "left_anti") if some_large else placed
    small = written(small.select("region", "node", "k1", "k2", "n", "sketch").groupBy("region").applyInArrow(lambda t: _likely(num, den)(t), "region long, node long, k1 long, k2 long"), "likely")
    keys = small.select("k1")
    if some_large:
        among = placed.join(large, "region", "left_semi").select("region", "node", "k1", "k2", "n")
        keys = keys.unionByName(among.select("k1"))
    # Texts that no region asks for need not be shuffled: a semi-join by the first hash leaves them, as long as the hashes can be broadcast.
    keys = written(keys.distinct(), "keys")
    held = docs.join(F.broadcast(keys), "k1", "left_semi") if keys.count() <= MAX_KEYS else docs
    texts = held.groupBy("k1", "k2").agg(F.min("text").alias("text"))  # a row and its repeats once
    edges = small.join(texts, ["k1", "k2"]).select("region", "node", "text").groupBy("region").applyInArrow(lambda t: _join_region(shingle, num, den)(t), "a long, b long")
    if some_large:
        members = written(among.join(texts, ["k1", "k2"]).select("region", "node", "n", "text"), "members")
        stars, found = _split(members, shingle, num, den, region)
        edges = edges.unionByName(stars).unionByName(found)
    labels = components(edges)
    of_node = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("low"))
    low = of_node.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "low")
    smallest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(smallest, "component").select("node", "component_id")
    full = rows.where("n > 0").join(named, "node").select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _split(members: DataFrame, shingle: int, num: int, den: int, region: int) -> tuple[DataFrame, DataFrame]:
    """Links inside large regions: those of documents to their region's pivot, and those of open documents to others (as components of blocks).

    The first pivot is the region's smallest node; the others are the smallest by other hashes. All counts are partial aggregates, and
    only the pivots' texts meet all documents of their region.
    """
    radius = 1 - num / den + 1e-9
    least = [F.min("node")] + [F.min_by("node", F.xxhash64(F.lit(j), "node")) for j in range(1, PIVOTS)]
    chosen = members.groupBy("region").agg(*[x.alias(f"p{j}") for j, x in enumerate(least)]).select("region", F.posexplode(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("j", "node"))
    pivots = members.select("region", "node", "text").join(chosen, ["region", "node"]).groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "text"))), lambda x: x["text"]).alias("pivots"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, distances, known = [], [], {}
            for s, texts in zip(_sets(batch.column(3), shingle), batch.column(4).to_pylist(), strict=True):
                key = tuple(map(hash, texts))
                if key not in known:
                    known = {key: list(_sets(pa.array(texts, pa.string()), shingle))}
                inter = [len(np.intersect1d(s, p, assume_unique=True)) for p in known[key]]
                near.append(bool(linked(inter[0], len(s), len(known[key][0]), num, den)))
                distances.append([1 - i / max(1, len(s) + len(p) - i) for i, p in zip(inter, known[key], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near), pa.array(distances, pa.list_(pa.float64()))], names=["region", "node", "n", "text", "near", "d"])

    measured = written(members.join(pivots, "region").select("region", "node", "n", "text", "pivots").mapInArrow(compare, "region long, node long, n long, text string, near boolean, d array<double>"), "measured")
    first = chosen.where("j = 0").select("region", F.col("node").alias("pivot"))
    stars = measured.where("near").select("region", "node").join(first, "region").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    nearest = F.array_min("d")
    own = F.array_position("d", nearest).cast("int")
    ring = lambda d: F.floor(d / radius).cast("int")
    # Partners: every document, in each cell whose pivot is at most twice the threshold further than the nearest. Open ones look in their own cell.
    cells = F.filter(F.sequence(F.lit(1), F.size("d")), lambda c: F.element_at("d", c) <= nearest + 2 * radius)
    partners = measured.select("region", "node", "n", F.explode(cells).alias("cell"), "d").withColumn("ring", ring(F.element_at("d", F.col("cell"))))
    seekers = measured.where("not near").select("region", "node", "n", own.alias("cell"), ring(nearest).alias("ring"))
    place = ["region", "cell", "ring"]
    parts = lambda rows, name: rows.groupBy(*place).agg(F.ceil(F.greatest(F.count(F.lit(1)) * 2 / F.lit(float(region)), F.sum("n") * 2 / F.lit(float(region * SHINGLES)))).cast("int").alias(name))
    blocks = written(parts(seekers, "blocks"), "blocks")
    buckets = parts(partners.join(blocks.select("region", "cell").distinct(), ["region", "cell"], "left_semi"), "buckets")
    # A task is a block of seekers of one ring against a bucket of partners of the same ring or one beside it.
    around = blocks.select(*place, "blocks", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("other"))
    tasks = written(around.join(buckets.withColumnRenamed("ring", "other"), ["region", "cell", "other"]).select("region", "cell", "ring", "other", "blocks", "buckets"), "tasks")
    part = lambda count: F.pmod(F.xxhash64(F.lit(97), "node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    key = ["region", "cell", "ring", "other", "block", "bucket"]
    asked = seekers.join(tasks, place).withColumn("block", part("blocks")).select(*key[:4], "block", every("buckets").alias("bucket"), "node", F.lit(True).alias("open"))
    offered = partners.withColumnRenamed("ring", "other").join(tasks, ["region", "cell", "other"]).withColumn("bucket", part("buckets")).select(*key[:4], every("blocks").alias("block"), "bucket", "node", F.lit(False).alias("open"))
    dealt = asked.unionByName(offered).join(measured.select("region", "node", "text"), ["region", "node"]).select(F.xxhash64(*key).alias("task"), "node", "open", "text")
    return stars, dealt.groupBy("task").applyInArrow(lambda t: _join_block(shingle, num, den)(t), "a long, b long")
