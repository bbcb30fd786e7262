"""Sharding along a Hilbert curve over metadata.

Source, language and text size are each quantised at their own quantiles into ``2 ** BITS``
steps: numbers at approximate quantiles, texts, compared whole, by the share of rows that sort
before them (counts per distinct value, range-partitioned, with running sums); steps in which no
value begins are left out. Documents are ordered by the index of their cell on a Hilbert curve through the grid
of steps, so neighbours in the order are close in every dimension, and the order is cut into
runs of equal counts (law ``rows``: at most one row apart). A run then spans short ranges of
all dimensions, which the minima and maxima of its file show.

The order is not made by one global sort. A cell is split into ``salts`` parts by a hash of
the id; counts per part give each part its first rank (prefix sums over at most
``8 ** BITS`` cells, then over the parts of one cell), and ranks are numbered inside the parts
only. A cell that holds most of the rows is thus spread over its parts. The salt is a hash of the
whole row, so rows of one id, or without an id, are spread too.

Rows are dealt once, by the run of ranks their part begins in, and are sorted inside: a task, and
the file it writes, holds one run of the curve. A part that crosses the end of a run stays whole.

Nulls in a dimension, and in the id, go first. Rows of one id are ordered by their other columns;
repeated rows are separate rows. A null text has no bytes, its size is ``OVERHEAD``; a very long one
is a row like any other. An empty table gives no rows. Columns called ``shard`` or ``slot`` are
replaced by the new ones, whatever their case; other extra columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import broadcast_if_few, free_name, written

SHARDS = 40
BITS = 4
OVERHEAD = 16
#: Rows that a part of a cell holds at most if all rows lie in one cell, about.
PART_ROWS = 250_000
LEAST_SALTS, MOST_SALTS = 16, 4096
LAW = "rows"


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position of a grid point on the Hilbert curve, by Skilling's transposition of its axes."""
    x, dims = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(dims):
            if x[i] >> level & 1:
                x[0] ^= below
            else:
                swap = (x[0] ^ x[i]) & below
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = index << 1 | (c ^ flip) >> level & 1
    return index


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """The grid with its curve index: ``cell, h``; its size is fixed by the two parameters.

    It is sent as an Arrow table: rows would start Python workers on the executors, that then stay.
    """
    if dims * bits > 16:
        raise ValueError("the grid has at most 2**16 cells")
    side = 1 << bits
    h = [hilbert_index(tuple((c // side**d) % side for d in range(dims)), bits) for c in range(side**dims)]
    return spark.createDataFrame(pa.table({"cell": pa.array(range(side**dims), pa.int32()), "h": pa.array(h, pa.int32())})).coalesce(1)


def text_cuts(spark: SparkSession, values: DataFrame, steps: int) -> dict[str, list[str]]:
    """Per text column, the values at which a new step begins, at most ``steps - 1`` of them.

    A value's step is the share of rows that sort before it. Equal values are counted first, so
    what is range-partitioned and summed up is one row per distinct value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in values.columns]))
    counts = values.select(each.alias("x")).select("x.*").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    # Written, because ranges are made from a sample and must be the same for both readers.
    ranges = counts.repartitionByRange("dim", "value").withColumn("part", F.spark_partition_id())
    counts = written(spark, ranges, "value-counts")
    sums = counts.groupBy("dim", "part").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("dim", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy("dim")).alias("total"))
    inside = Window.partitionBy("dim", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    step = F.call_function("div", before * F.lit(steps), F.col("total"))
    placed = counts.join(broadcast_if_few(sums), ["dim", "part"]).select("dim", "value", step.alias("step"))
    cuts: dict[str, list[str]] = {c: [] for c in values.columns}
    for r in placed.where("value IS NOT NULL AND step > 0").groupBy("dim", "step").agg(F.min("value").alias("value")).collect():
        cuts[r.dim].append(r.value)
    return cuts


def ranked(spark: SparkSession, documents: DataFrame, dimensions: dict[str, Column], key: str = "doc_id", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The documents with ``shard`` and ``slot``.

    ``dimensions`` maps names to columns of the documents. All columns are kept; ``shard`` and
    ``slot`` must not be among them.
    """
    names = [free_name(documents, f"dim{i}") for i in range(len(dimensions))]
    made = documents.select("*", *[c.alias(n) for c, n in zip(dimensions.values(), names)])
    texts = [n for n in names if dict(made.dtypes)[n] == "string"]
    numbers = [n for n in names if n not in texts]
    steps = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    found = made.select(*[F.col(n).cast("double").alias(n) for n in numbers]).agg(
        F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(n, steps, 10_000).alias(n) for n in numbers]
    ).first()
    cuts = text_cuts(spark, made.select(*texts), 1 << bits) if texts else {}
    rows, salts = found["rows"], min(MOST_SALTS, max(LEAST_SALTS, -(-found["rows"] // PART_ROWS)))
    cell = F.lit(0)
    for d, n in enumerate(names):
        if n in cuts:
            above = [F.col(n) >= F.lit(c) for c in cuts[n]]
        else:
            above = [F.col(n).cast("double") > c for c in sorted(set(found[n] or []))]
        step = sum((F.when(a, 1).otherwise(0) for a in above), F.lit(0))
        cell = cell + step * F.lit((1 << bits) ** d)
    h, salt, base, run = (free_name(documents, x) for x in ("h", "salt", "base", "run"))
    grid = F.broadcast(curve(spark, len(names), bits).select(F.col("cell").alias(names[0]), F.col("h").alias(h)))
    cell_name = free_name(made, "cell")
    placed = made.withColumn(cell_name, cell).drop(*names).withColumnRenamed(cell_name, names[0]).join(grid, names[0]).drop(names[0])
    others = [c for c, kind in documents.dtypes if c != key and "map<" not in kind and "variant" not in kind]
    placed = placed.withColumn(salt, F.pmod(F.xxhash64(F.lit(5), *[F.col(f"`{c}`") for c in (key, *others)]), F.lit(salts)).cast("int"))

    parts = placed.groupBy(h, salt).agg(F.count(F.lit(1)).alias("n"))
    cells = parts.groupBy(h).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy(h).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col(h).alias("ch"), F.coalesce(before, F.lit(0)).alias("cell_base"))
    inside = F.sum("n").over(Window.partitionBy(h).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(cells), F.col(h) == F.col("ch"))
    parts = parts.select(F.col(h).alias("ph"), F.col(salt).alias("ps"), (F.col("cell_base") + F.col("inside")).alias(base))

    n = F.lit(max(rows, 1))
    runs = shards * max(1, -(-rows // (shards * PART_ROWS)))
    based = placed.join(broadcast_if_few(parts), (F.col(h) == F.col("ph")) & (F.col(salt) == F.col("ps"))).drop("ph", "ps")
    based = based.withColumn(run, F.call_function("div", F.col(base) * F.lit(runs), n).cast("int"))
    order = Window.partitionBy(run, h, salt).orderBy(*[F.col(f"`{c}`") for c in (key, *others)])
    numbered = based.repartitionById(runs, run).withColumn("slot", F.row_number().over(order))
    rank = F.col(base) + F.col("slot") - 1
    out = numbered.withColumn("shard", F.call_function("div", rank * F.lit(shards), n).cast("int"))
    first = F.call_function("div", F.col("shard").cast("long") * n + F.lit(shards - 1), F.lit(shards))
    return out.withColumn("slot", rank - first).drop(h, salt, base, run)


def standard_dimensions(documents: DataFrame) -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "size": F.coalesce(F.octet_length("text"), F.lit(0))}


def assignments(spark: SparkSession, documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document; no text is shuffled."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    narrow = documents.select("doc_id", "source", "lang", size.alias("size"), crc.cast("long").alias("text_crc32"))
    placed = ranked(spark, narrow, {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}, shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(spark: SparkSession, documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with ``shard`` and ``slot``, one run of the curve in a task and a file."""
    kept = documents.drop(*[c for c in documents.columns if c.lower() in ("shard", "slot")])
    return ranked(spark, kept, standard_dimensions(kept), shards=shards)
