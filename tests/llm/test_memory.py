"""What the pipeline's stages take in executors besides their rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reliefsignals.llm import bounds, components, decontaminate, jaccard, quality, repeats, sharding


def test_sharding_starts_no_python_workers(spark, monkeypatch, tmp_path):
    docs = spark.range(500).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")
    )
    monkeypatch.setattr(spark.sparkContext, "pythonExec", str(tmp_path / "no-python"))
    rows = sharding.sharded(spark, docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500)) and {r.shard for r in rows} == set(range(40))
    grid = {r.cell: r.h for r in sharding.curve(spark, 2, 3).collect()}
    assert grid == {x + 8 * y: sharding.hilbert_index((x, y), 3) for x in range(8) for y in range(8)}


@pytest.mark.parametrize(
    "read", [jaccard.shingle_sets, quality.features, lambda texts: decontaminate._sets(texts, [5])], ids=["shingles", "features", "words"]
)
def test_words_are_hashed_in_little_memory(read):
    numbers = np.random.default_rng(5).integers(0, 10_000, (1_000, 350)).tolist()
    texts = pa.array([" ".join(map(str, row)) for row in numbers], pa.large_string())
    assert texts.nbytes > 1_500_000
    tracemalloc.start()
    try:
        assert sum(1 for _ in read(texts)) == 1_000
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()


def test_texts_are_read_in_small_batches(spark, tmp_path):
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    spark.range(5_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    try:
        for n in names:
            spark.conf.unset(n)
        bounds.with_small_reads(spark)
        read = spark.read.parquet(str(tmp_path / "t")).filter("id >= 0")
        sizes = read.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= bounds.ARROW_ROWS and sum(r.n for r in sizes) == 5_000
        assert int(spark.conf.get(names[0])) == bounds.ARROW_ROWS
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_weights_come_to_the_driver_without_rows(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), F.col("id") * 300 + i)))
    labelled = spark.range(300).select(F.col("id").alias("doc_id"), words.alias("text"), (F.col("id") % 2).alias("label"))
    tracemalloc.start()
    try:
        weights = quality.train(labelled)
        assert tracemalloc.get_traced_memory()[1] < 12_000_000
    finally:
        tracemalloc.stop()
    assert (weights != 0).sum() > 50_000


def test_filters_come_to_the_driver_without_rows(spark):
    def runs(batches):
        for batch in batches:
            hashes = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r, packed in repeats.split(np.repeat(hashes, 2), 16, 2):
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "packed": [packed]})

    sent = spark.range(1, numPartitions=1).mapInArrow(runs, "range int, packed binary")
    tracemalloc.start()
    try:
        twice, often = repeats.repeated(sent, 16, (2, 3), 26)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    known = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert twice.contains(known).all() and not often.contains(known).any()
    assert most < twice.marks.nbytes + often.marks.nbytes + 2_000_000


def test_shingles_take_little_on_their_way(spark):
    """Fewer bits of a hash lose none that repeats, and hardly any other looks repeated."""
    rng = np.random.default_rng(9)
    hashes = rng.integers(0, 2**64, 2_000_000, dtype=np.uint64)
    parts = [hashes[:1_000_000], np.concatenate((hashes[1_000_000:], hashes[:100_000]))]
    runs = [run for part in parts for run in repeats.split(part, 256, 64, jaccard.NAME_BITS)]
    assert sum(len(packed) for _, packed in runs) < 2.25 * 2_100_000
    sent = spark.createDataFrame([(r, bytearray(p)) for r, p in runs], "range int, packed binary")
    (twice,) = repeats.repeated(sent, 256, (2,), jaccard.BITS, jaccard.NAME_BITS)
    read = repeats.Repeated.of(twice.plain())
    assert read.contains(hashes[:100_000]).all() and read.contains(hashes[100_000:]).mean() < 0.02


@pytest.fixture
def tables(monkeypatch):
    """Names of the tables that components and the join write."""
    names = []

    def noted(spark, frame, name, write=bounds.written):
        names.append(name)
        return write(spark, frame, name)

    for module in (components, jaccard):
        monkeypatch.setattr(module, "written", noted)
    return names


@pytest.mark.parametrize(
    ("links", "rounds"),
    [([], 1), ([(5, 1), (1, 7), (6, 2), (2, 2)], 1), ([(2, 1), (3, 2), (3, 3)], 2), ([(1, 9), (9, 4), (4, 8), (8, 3), (30, 20), (20, 10), (10, 30)], 3)],
    ids=["none", "stars", "chain", "mixed"],
)
def test_components_end_without_a_round_that_changes_nothing(spark, tables, links, rounds):
    least = {x: x for link in links for x in link}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == {x: m for x, m in least.items() if x != m}
    assert tables.count("links") == rounds


def test_links_inside_components_are_followed_once(spark, tables):
    """The first components are stars; what is found between them joins components, not nodes again."""
    word = [f"w{i}" for i in range(100)]
    texts = [" ".join(word[:k] + [f"x{k}"] + word[k + 1 :]) for k in range(5, 95, 5)]
    rows = [(i, t) for i, t in enumerate([" ".join(word), *texts])]
    found = jaccard.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and len(found) == len(rows)
    assert tables.count("centre") == 1 and tables.count("links") <= 3
