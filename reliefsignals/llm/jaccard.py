"""N-gram Jaccard join by count vectors, exact, with connected components.

A document's set holds its distinct shingles of five words (runs of anything but ASCII white
space, A-Z lower-cased); with fewer words, the whole sequence as one shingle; without words it
is empty and linked with nothing. Two documents link when
``100 * intersection >= 75 * union``.

1. Sets are hashed. Documents with equal sets form a class; classes are the nodes below.
2. Corpus counts of all shingles become two filters (``repeats``): shingles that occur in two
   sets or more, and frequent ones. A document that shares less than 75 % of its shingles with
   any other set cannot have a link and goes no further.
3. Shingles have one global order: unshared, shared, frequent, each by hash. Two linked sets
   have a common shingle among the first ``n - ceil(0.75 n) + 1`` of each, so these are the
   keys; documents meet in the blocks of their keys. Blocks of the same nodes (their number, hub
   and the exclusive or of their names agree) hold the same pairs: one stays, with their number.
4. A node is first compared with one other node only: of the hubs of its blocks, the one it
   shares most keys with. A block's hub is its node with the smallest share of unshared
   shingles, for copies with edits resemble their origin more than each other. Components are
   formed; what is left are blocks that hold several.
5. In each of those, shingles are hashed into groups, about as many as the set has shingles; the
   counts per group are a point, and a packed R-tree holds the points of a block. The summed
   coordinate minima of two points or boxes bound the overlap from above; pairs of boxes that
   cannot reach the threshold, or lie in one component, are pruned together. Sets without a
   common shingle have half of the bound that a link needs, whatever their size. A block of
   many nodes is cut by size and dealt out by pairs of parts (``_dealt``).
6. Surviving pairs are verified on whole sets and components joined. Here as in 4, pairs that have
   too few shared shingles for a link are left out before sets are sent.

The R-tree is built per block because over a whole corpus its boxes overlap too much in so many
dimensions to prune anything. No step limits partners or candidates.

Null texts are empty. Repeated rows and equal sets share a class. A null id takes part and is
never a component's id unless all its ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm import blocks, repeats
from reliefsignals.llm.bounds import broadcast_if_few, free_name, with_small_reads, written
from reliefsignals.llm.components import components

WIDTH = 5
PERCENT = 75
#: A shingle of so many sets is frequent; it only comes later in the global order.
FREQUENT = 64
#: Size of each of the two filters, 8 MB.
BITS = 26
#: Bits of a shingle below its range's number on its way to the filters. A range stands for 2 to 4 MB
#: of text whatever the input, less than a million shingles, so some 1 % of the unshared ones look shared.
NAME_BITS = 26
#: Groups of the count vector of a small set; others have the power of two from their size on.
LEAST_GROUPS = 64
LEAF = 16
#: Nodes that are compared in one place; a block of more is dealt out by pairs of its parts.
PART_NODES = 1_000
#: Rows of blocks that a task gets, about.
TASK_ROWS = 2_000


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = blocks.text_bytes(texts)
    data = blocks.ascii_lower()[data]
    classes, powers = blocks.byte_classes("space"), blocks.Powers()
    for first, last in blocks.spans_of_documents(offsets, blocks.WORDS_CHUNK):
        start = offsets[first]
        words, at = blocks.tokens(data[start : offsets[last]], offsets[first : last + 1] - start, classes, powers)
        values, bounds = blocks.shingles(words, at, WIDTH)
        for low, high in zip(bounds[:-1], bounds[1:]):
            yield np.unique(values[low:high])


def node_of(values: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = blocks.mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(blocks.mixed(np.array([total], np.uint64)).view(np.int64)[0])


def groups_of(n: int) -> int:
    """Length of the count vector of a set of ``n``: about one shingle in a group, whatever the size."""
    return max(LEAST_GROUPS, 1 << (n - 1).bit_length())


def _kind(n: int) -> type:
    """The smallest integers that no count of a set of ``n`` exceeds."""
    return np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.uint32


def count_vector(values: np.ndarray) -> bytes:
    """Counts per group, compressed: most are 0 or 1, so a group takes about two bits on its way."""
    groups = groups_of(len(values))
    counts = np.bincount((values & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return repeats.planes(counts.astype(_kind(len(values))))


def _marks(documents: DataFrame, ranges: int) -> DataFrame:
    """A row per document (id, set size, node), and rows with packed shingles."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("range", pa.int32()), ("packed", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches):
            sets = list(shingle_sets(batch.column(1)))
            sizes, nodes = [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets]
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                schema=schema,
            )
            once = {k: s for k, s in zip(nodes, sets) if k is not None}
            if once:
                for r, packed in repeats.split(np.concatenate(list(once.values())), ranges, FREQUENT, NAME_BITS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip((None, None, None, r, packed), schema.types)], schema=schema
                    )

    return documents.mapInArrow(run, "doc_id bigint, n bigint, node bigint, range int, packed binary")


def _candidate_sets(documents: DataFrame, sent: Broadcast) -> DataFrame:
    """Nodes that can have links: shingles in the global order, number of unshared ones, count vector."""
    kind = pa.schema(
        [("node", pa.int64()), ("n", pa.int32()), ("unshared", pa.int32()), ("counts", pa.binary()), ("shingles", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_shared, is_frequent = map(repeats.Repeated.of, sent.value)
        for batch in blocks.slices(batches):
            rows: dict[int, tuple] = {}
            for s in shingle_sets(batch.column(0)):
                known = is_shared.contains(s)
                if not len(s) or 100 * int(known.sum()) < PERCENT * len(s):
                    continue
                node = node_of(s)
                if node not in rows:
                    order = np.argsort(known.astype(np.int8) + is_frequent.contains(s), kind="stable")
                    rows[node] = (node, len(s), int((~known).sum()), count_vector(s), s[order].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows.values()), kind.types)], schema=kind)

    found = documents.select("text").mapInArrow(
        run, "node bigint, n int, unshared int, counts binary, shingles array<bigint>"
    )
    return found


def linked(shared: Column, n: Column, m: Column) -> Column:
    return F.lit(100) * shared >= F.lit(PERCENT) * (n + m - shared)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that can link: what two sets have in common are shared shingles of both."""
    found = pairs
    for x in "ab":
        span = sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), (F.col("n") - F.col("unshared")).alias(f"most_{x}"))
        found = found.join(span, x)
    return found.filter(linked(F.least("most_a", "most_b"), F.col("n_a"), F.col("n_b"))).select(pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that link, decided on whole sets, with all columns of ``pairs``.

    Few pairs are sent to the sets, rather than the sets shuffled to them.
    """
    side = {x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab"}
    wanted = broadcast_if_few(pairs.select("b").distinct())
    joined = side["a"].join(broadcast_if_few(pairs), "a").join(side["b"].join(wanted, "b", "left_semi"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return joined.withColumn("shared", shared).filter(linked(F.col("shared"), F.col("n_a"), F.col("n_b"))).select(pairs.columns)


def overlapping(counts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different groups whose bound reaches the threshold, by a packed R-tree.

    With ``own``, pairs of which neither row has that mark are left out.

    A link needs an intersection of ``PERCENT / (100 + PERCENT)`` of both sizes together; the
    summed minima of two count vectors are at least the intersection.
    """
    order = np.lexsort([*counts.T[:4], sizes])

    def build(rows: np.ndarray) -> tuple:
        box = (counts[rows].max(axis=0), int(sizes[rows].min()), int(sizes[rows].max()))
        one = groups[rows[0]] if (groups[rows] == groups[rows[0]]).all() else None
        if len(rows) <= LEAF:
            return (*box, one, rows, None)
        spread = np.argmax(counts[rows].max(axis=0) - counts[rows].min(axis=0))
        by = rows[np.argsort(sizes[rows], kind="stable")]
        if box[2] * PERCENT <= box[1] * 100:
            by = rows[np.argsort(counts[rows, spread], kind="stable")]
        half = len(by) // 2
        return (*box, one, rows, (build(by[:half]), build(by[half:])))

    def may(least_a: int, most_a: int, least_b: int, most_b: int, bound: int) -> bool:
        if 100 * most_a < PERCENT * least_b or 100 * most_b < PERCENT * least_a:
            return False
        return (100 + PERCENT) * bound >= PERCENT * (least_a + least_b)

    if len(order) < 2:
        return
    tree = build(order)
    stack = [(tree, tree)]
    while stack:
        x, y = stack.pop()
        if x[3] is not None and x[3] == y[3]:
            continue
        if x is not y and not may(x[1], x[2], y[1], y[2], int(np.minimum(x[0], y[0]).sum())):
            continue
        if x[5] is None and y[5] is None:
            r, s = x[4], y[4]
            bound = np.minimum(counts[r][:, None, :], counts[s][None, :, :]).sum(axis=2)
            n, m = sizes[r][:, None], sizes[s][None, :]
            good = ((100 + PERCENT) * bound >= PERCENT * (n + m)) & (groups[r][:, None] != groups[s][None, :])
            if own is not None:
                good &= own[r][:, None] | own[s][None, :]
            if x is y:
                good = np.triu(good, 1)
            for i, j in zip(*np.nonzero(good)):
                yield int(r[i]), int(s[j])
        elif x is y:
            a, b = x[5]
            stack += [(a, a), (b, b), (a, b)]
        elif y[5] is None or (x[5] is not None and len(x[4]) >= len(y[4])):
            stack += [(c, y) for c in x[5]]
        else:
            stack += [(x, c) for c in y[5]]


def near_pairs(vectors: list[bytes], sizes: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """``overlapping`` for sets whose count vectors have their own lengths.

    Linked sets differ in size by a third at most, so in length by a factor of two. The longer
    vector is folded, which adds up groups that fall into one: the sets of one length are indexed
    with those of the next, folded, and pairs of the latter are left to their own length.
    """
    lengths = np.array([groups_of(int(n)) for n in sizes])

    def folded(i: int, length: int) -> np.ndarray:
        v = repeats.from_planes(vectors[i], _kind(int(sizes[i]))).astype(np.int32)
        return v if len(v) == length else v[:length] + v[length:]

    for length in np.unique(lengths):
        rows = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        own = lengths[rows] == length
        if len(rows) < 2 or (groups[rows] == groups[rows[0]]).all():
            continue
        points = np.stack([folded(i, length) for i in rows])
        for i, j in overlapping(points, sizes[rows], groups[rows], own):
            yield int(rows[i]), int(rows[j])


def _dealt(members: DataFrame) -> DataFrame:
    """Members ``key, node, n, m`` and more in cells ``key, lo, hi``, where their pairs are compared.

    A block of ``m`` nodes up to ``PART_NODES`` is one cell. A larger one is cut by size, for
    linked sets are a step of sizes apart at most, then at random: each pair of parts is a cell.
    A cell holds two parts at most, so no task holds the block.
    """
    small, large = members.filter(F.col("m") <= PART_NODES), members.filter(F.col("m") > PART_NODES)
    whole = F.lit(0).cast("long")
    step = F.floor(F.log("n") / F.log(F.lit(100.0 / PERCENT)) + F.lit(1e-9))
    stepped = large.withColumn("step", step)
    many = stepped.groupBy("key", F.col("step").alias("cut")).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_NODES)).alias("parts"))
    # A set goes to the step of its size as one of its own and to the next as a guest.
    visits = stepped.withColumn("cut", F.explode(F.array("step", F.col("step") + 1))).join(many, ["key", "cut"])
    part = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    visits = visits.withColumn("part", part).withColumn("other", other).withColumn("guest", F.col("cut") != F.col("step"))
    lo = F.when(F.col("guest"), F.col("other")).otherwise(F.least("part", "other"))
    hi = F.when(F.col("guest"), F.col("other")).otherwise(F.greatest("part", "other"))
    base = (F.col("cut") + 1) * F.lit(1 << 32)
    spread = visits.select(*members.columns, (base + lo).alias("lo"), (base + hi).alias("hi"))
    return small.select("*", whole.alias("lo"), whole.alias("hi")).unionByName(spread)


def _surviving_pairs(members: DataFrame, ranges: int, most: int) -> DataFrame:
    """Pairs ``a, b`` and their components ``of_a, of_b``, which differ, from blocks of ``key, node, component, n, m, counts``.

    ``most`` is the size of the largest block: where none is to be dealt out, the plan is spared that part.
    """

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "lo", "hi", "node"], kind="stable")
        nodes, found = group["node"].to_numpy(np.int64), set()
        vectors = group["counts"].tolist()
        sizes, parts = group["n"].to_numpy(np.int64), group["component"].to_numpy(np.int64)
        cells = group[["key", "lo", "hi"]].to_numpy(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(axis=1), [True])))
        for low, high in zip(edges[:-1], edges[1:]):
            for i, j in near_pairs(vectors[low:high], sizes[low:high], parts[low:high]):
                (a, of_a), (b, of_b) = sorted((nodes[low + x], parts[low + x]) for x in (i, j))
                found.add((a, b, of_a, of_b))
        return pd.DataFrame(sorted(found), columns=["a", "b", "of_a", "of_b"], dtype=np.int64)

    cells = _dealt(members) if most > PART_NODES else members.withColumns({x: F.lit(0).cast("long") for x in ("lo", "hi")})
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(ranges)))
    return dealt.groupBy("block").applyInPandas(join, "a bigint, b bigint, of_a bigint, of_b bigint").distinct()


def classes(spark: SparkSession, documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    with_small_reads(spark)
    slim = documents.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    ranges = repeats.ranges_for(slim)
    passed = written(spark, _marks(slim, ranges), "marks")
    marks = passed.filter("range is null").select("doc_id", "n", "node")
    shared, frequent = repeats.repeated(passed.filter("range is not null").select("range", "packed"), ranges, (2, FREQUENT), BITS, NAME_BITS)
    sent = spark.sparkContext.broadcast((shared.plain(), frequent.plain()))
    del shared, frequent
    firsts = marks.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("node IS NOT NULL AND m > 1")
    shared_nodes = marks.join(firsts, "node").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = written(spark, shared_nodes.filter("copy").select("doc_id"), "copies")
    one_each = slim.join(broadcast_if_few(copies), "doc_id", "left_anti")
    found = _candidate_sets(one_each, sent)
    # Rows that repeat an id, or have none, are still there; only then is a shuffle of sets needed.
    if not shared_nodes.filter("NOT copy").groupBy("node").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["node"])
    sets = written(spark, found, "sets")
    sent.destroy()

    first = F.col("n") - F.floor((F.lit(PERCENT) * F.col("n") + 99) / 100).cast("int") + 1 - F.col("unshared")
    apart = F.col("unshared").cast("double") / F.col("n")
    keyed = sets.filter(first > 0).select("node", apart.alias("apart"), F.explode(F.slice("shingles", F.col("unshared") + 1, first)).alias("key"))
    keys = written(spark, keyed, "keys")
    block = keys.groupBy("key").agg(
        F.min(F.struct("apart", "node"))["node"].alias("b"), F.count(F.lit(1)).alias("m"), F.bit_xor("node").alias("nodes")
    ).filter("m > 1")
    block = block.groupBy("nodes", "m", "b").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("blocks"))
    met = written(spark, keys.join(block.select("key", "b", "blocks"), "key").select("key", "node", "b", "blocks"), "met")
    meets = met.filter("node != b").groupBy(F.col("node").alias("a"), "b").agg(F.sum("blocks").alias("m"))
    centre = meets.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    centre = written(spark, _possible(centre, sets), "centre")
    near = written(spark, _verified(centre, sets), "near")
    parts = components(spark, near)

    of_node = sets.select("node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = written(spark, of_node.select("node", "component"), "parts")
    placed = met.select("key", "node").join(of_node, "node")
    several = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")
    ).filter("low != high")
    several = written(spark, several.select("key", "m"), "several")
    rows, most = several.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    members = placed.join(several, "key").join(sets.select("node", "n", "counts"), "node")
    survivors = _surviving_pairs(members, max(1, -(-rows // TASK_ROWS)), most)
    pairs = written(spark, _possible(survivors, sets), "pairs")
    # Components are final but for the links between them, so only those links are left to follow.
    between = _verified(pairs, sets).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    joined = components(spark, between).select(F.col("node").alias("part"), F.col("component").alias("whole"))

    least = marks.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(of_node, "node", "left")
    least = least.withColumn("part", F.coalesce("component", "node")).drop("component")
    least = least.join(broadcast_if_few(joined), "part", "left").withColumn("component", F.coalesce("whole", "part"))
    of_component = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(of_component, "component").select("node", "component_id")
    empty = marks.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = marks.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(empty)


def representatives(spark: SparkSession, documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents, all columns, that have the smallest id of their component.

    Rows that share that id all stay, as do rows without words and rows without an id.
    """
    other, part = free_name(documents, "other_id"), free_name(documents, "part")
    found = classes(spark, documents, id_column).select(F.col("doc_id").alias(other), F.col("component_id").alias(part))
    gone = found.filter(F.col(other) != F.col(part)).select(other).distinct()
    return documents.join(gone, F.col(id_column) == F.col(other), "left_anti")
