"""Merkle manifest of a table, with proofs by pointer jumping.

``H`` is the lower-case hexadecimal SHA-256 of its inputs in a row; digests enter it as that text.
A row's leaf is ``H`` of its columns, each ``-`` if null, else the number of its UTF-8 bytes,
``:`` and the value. Per group (source) leaves ascend by id; while several nodes remain, every
``FAN`` consecutive ones, the last run being shorter, become their ``H``. What remains, a lone
leaf itself, is the group's subroot. Subroots in the order of groups (null first, bytewise) give
the root in the same way.

1. Rows get a position by a range partitioning over group, id and leaf. Only partition counts
   are summed up in one place, so a group of any size is spread over many tasks.
2. Levels are built bottom up: a run is one row with its children, and each level has a
   sixteenth of the rows below. A level is written before the next one reads it.
3. Every inner node points at its parent and holds its segment: the siblings to its left and to
   its right. A self-join replaces each pointer by that of the node it points at and concatenates
   the segments, which doubles the distance. After ``log2`` of the height all point at the root.
4. Each row joins its parent once more and has its whole proof. A run has ``FAN`` rows, so no key
   of that join is hot. The nodes that many others point at, near the root, are few and broadcast
   when a count shows it.

Rows that share an id are ordered by leaf; repeated rows have equal leaves, where the order
does not matter. Rows without an id come first in their group. Null texts and empty ones
differ (``-`` and ``0:``). Texts of any length are hashed where they are read and never shuffled.
An empty table gives no rows. Other columns of the table take no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import broadcast_if_few, written

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree whose lowest nodes are the groups' subroots.
TOP = -1
#: Nodes with their segments that are broadcast at most, some 50 MB.
BROADCAST_NODES = 8_000
KEY = ("tree", "level", "idx")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The leaf of a row with these columns."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof, an array of ``left, right`` from the bottom up."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def positions(spark: SparkSession, rows: DataFrame, keys: list[str], name: str, position: str) -> DataFrame:
    """The rows with their place, from 0, in the order of the keys.

    The sorted rows are written with their numbers, so a lost executor cannot change them. The
    window below runs over one row for each partition.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_rows = written(spark, dealt.withColumn("seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("seq", 33)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("many"))
    before = F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = sorted_rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn(position, F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


def _leaves(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree, place in it and size of it, and the groups with their tree numbers."""
    placed = positions(spark, rows, ["grp", "id", "leaf"], "merkle-leaves", "pos")
    groups = placed.groupBy("grp").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = written(spark, positions(spark, groups, ["grp"], "merkle-order", "tree"), "merkle-groups")
    of_group = broadcast_if_few(groups.withColumnRenamed("grp", "g"))
    leaves = placed.join(of_group, F.col("grp").eqNullSafe(F.col("g"))).withColumn("idx", F.col("pos") - F.col("start"))
    return leaves.drop("g", "pos", "start"), groups


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """The next level: ``tree, level, idx, children, hash`` and the number of its nodes in the tree."""
    run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    runs = nodes.groupBy("tree", F.call_function("div", F.col("idx"), F.lit(FAN)).alias("i")).agg(run.alias("run"), F.first("n").alias("n"))
    children = F.transform("run", lambda x: x["hash"])
    runs = runs.select("tree", F.lit(level).alias("level"), F.col("i").alias("idx"), children.alias("children"), "n")
    above = F.call_function("div", F.col("n") + F.lit(FAN - 1), F.lit(FAN))
    return runs.select("tree", "level", "idx", "children", digest(F.concat_ws("", "children")).alias("hash"), above.alias("n"))


def _tree(spark: SparkSession, nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels above ``tree, idx, hash, n``, written one by one; ``most``: nodes of the largest tree."""
    levels = []
    while most > 1:
        levels.append(written(spark, _runs(nodes.filter("n > 1"), len(levels) + 1), f"merkle-{name}"))
        nodes, most = levels[-1], -(-most // FAN)
    return levels


def _segment(children: Column, at: Column) -> Column:
    """What stands to the left and to the right of the child at a place, counted from 0."""
    left, right = F.slice(children, F.lit(1), at), F.slice(children, at + F.lit(2), F.lit(FAN))
    return F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _paths(spark: SparkSession, levels: list[DataFrame], height: int) -> DataFrame:
    """``tree, level, idx, segments`` to the root, of every node above the leaves but the root.

    A subroot is named as the lowest node of the tree ``TOP``; ``levels`` hold every run above
    level 1 of the groups' trees and every run of that tree, named alike in ``k_*``.
    """
    child = _union(levels).select("*", F.posexplode("children").alias("at", "child"))
    pointers = child.select(
        "tree", (F.col("level") - 1).alias("level"), (F.col("idx") * FAN + F.col("at")).alias("idx"),
        F.array(_segment(F.col("children"), F.col("at"))).alias("segments"), *[F.col(f"k_{k}").alias(f"up_{k}") for k in KEY],
    )
    distance = 1
    while distance < height:
        pointers = written(spark, pointers, "merkle-jump")
        at = pointers.select("up_tree", "up_level", "up_idx").distinct()
        target = pointers.select(*[F.col(k).alias(f"up_{k}") for k in KEY], F.col("segments").alias("more"), *[F.col(f"up_{k}").alias(f"to_{k}") for k in KEY])
        target = broadcast_if_few(target.join(at, [f"up_{k}" for k in KEY], "left_semi"), BROADCAST_NODES)
        jumped = pointers.join(target, [f"up_{k}" for k in KEY], "left")
        segments = F.when(F.col("more").isNull(), F.col("segments")).otherwise(F.concat("segments", "more"))
        pointers = jumped.select(*KEY, segments.alias("segments"), *[F.coalesce(f"to_{k}", f"up_{k}").alias(f"up_{k}") for k in KEY])
        distance *= 2
    return pointers.select(*KEY, "segments")


def _proven(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows ``grp, id, leaf`` and more with ``subroot``, ``root`` and ``proof``."""
    leaves, groups = _leaves(spark, rows)
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    nodes = leaves.select("tree", "idx", F.col("leaf").alias("hash"), "n")
    below = _tree(spark, nodes, most or 0, "level")
    lone = nodes.filter("n = 1").select("tree", "hash")
    subroots = written(spark, _union([lone, *[x.filter("n = 1").select("tree", "hash") for x in below]]), "merkle-subroots")
    above = _tree(spark, subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", F.lit(n_groups).cast("long").alias("n")), n_groups, "top")
    top = above[-1] if above else subroots
    root = (top.select("hash").first() or [None])[0]

    is_subroot = (F.col("tree") != TOP) & (F.col("n") == 1)
    name = {"tree": F.lit(TOP), "level": F.lit(0), "idx": F.col("tree")}
    named = [x.select("*", *[F.when(is_subroot, name[k]).otherwise(F.col(k)).alias(f"k_{k}") for k in KEY]) for x in [*below, *above]]
    parents = named[0].select("tree", "k_tree", "k_level", "k_idx", "children") if below else None
    # A lone leaf is its group's subroot: a run by itself that is not hashed again.
    only = lone.select("tree", F.lit(TOP).cast("long").alias("k_tree"), F.lit(0).alias("k_level"), F.col("tree").alias("k_idx"), F.array("hash").alias("children"))
    parents = parents.unionByName(only) if below else only
    higher = named[1:] if below else named
    if higher:
        paths = _paths(spark, higher, len(higher))
        parents = parents.join(paths.select(*[F.col(k).alias(f"k_{k}") for k in KEY], "segments"), [f"k_{k}" for k in KEY], "left")
        parents = parents.withColumn("segments", F.coalesce("segments", F.array().cast("array<struct<left:string,right:string>>")))
    else:
        parents = parents.withColumn("segments", F.array().cast("array<struct<left:string,right:string>>"))
    parents = parents.join(broadcast_if_few(subroots.withColumnRenamed("hash", "subroot")), "tree").drop("tree")

    one_run = F.col("n") <= FAN
    own = leaves.withColumn("at", (F.col("idx") % FAN).cast("int"))
    own = own.withColumn("k_tree", F.when(one_run, F.lit(TOP)).otherwise(F.col("tree")).cast("long"))
    own = own.withColumn("k_level", F.when(one_run, 0).otherwise(1))
    own = own.withColumn("k_idx", F.when(one_run, F.col("tree")).otherwise(F.call_function("div", F.col("idx"), F.lit(FAN))))
    found = own.join(parents, [f"k_{k}" for k in KEY])
    proof = F.when(F.col("n") > 1, F.concat(F.array(_segment(F.col("children"), F.col("at"))), F.col("segments"))).otherwise(F.col("segments"))
    found = found.withColumn("proof", proof).withColumn("root", F.lit(root).cast("string"))
    return found.drop(*[f"k_{k}" for k in KEY], "at", "children", "segments", "tree", "idx", "n")


def proofs(spark: SparkSession, documents: DataFrame, id_column: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof`` of every row; ``fold(leaf, proof)`` is the root."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(group).cast("string").alias("grp"), leaf_of([F.col(c) for c in columns]).alias("leaf"))
    return _proven(spark, rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof")


def lower_cased(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Proofs of all rows as digests, and whether rows, a fifth of them tampered with, still verify."""
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf_of([*[columns[c] for c in COLUMNS[:-1]], lower_cased(F.col("text"))]))
    rows = documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf_of(list(columns.values())).alias("leaf"), changed.alias("changed")
    )
    found = _proven(spark, rows)
    siblings = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"])))
    found = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
