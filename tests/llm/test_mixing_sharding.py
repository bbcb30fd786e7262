import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from reliefsignals.llm import mixing, sharding


def documents(spark, n=4000):
    rows = [(i, f"text {i % 7}" if i % 11 else None, "en" if i % 3 else None, f"s{i % 4}" if i % 2 else "hot", "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string")


def test_rates_meet_the_weights(spark):
    docs = documents(spark)
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), ("s3", 0.0)], "source string, weight double")
    rows = mixing.mixed(docs, weights, total=40_000).collect()
    counts = Counter(r.source for r in rows)
    assert set(counts) == {"hot", "s1"}
    assert abs(counts["hot"] - 10_000) < 500 and abs(counts["s1"] - 30_000) < 900
    again = mixing.mixed(docs.repartition(7), weights, total=40_000).collect()
    assert Counter((r.doc_id, r.copy) for r in again) == Counter((r.doc_id, r.copy) for r in rows)
    copies = Counter(r.doc_id for r in rows if r.source == "s1")
    mean = sum(copies.values()) / 1000
    variance = sum((copies.get(i, 0) - mean) ** 2 for i in range(4000) if i % 4 == 1) / 1000
    assert 0.8 < variance / mean < 1.2
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_inverse_distribution(spark):
    cdf = spark.range(1).select(mixing.distribution(F.lit(2.5)).alias("c")).first().c
    expected, p = [], math.exp(-2.5)
    for k in range(len(cdf)):
        expected.append(p + (expected[-1] if expected else 0))
        p = p * 2.5 / (k + 1)
    assert all(abs(a - b) < 1e-12 for a, b in zip(cdf, expected)) and abs(cdf[-1] - 1) < 1e-12


def test_null_source_is_a_source(spark):
    docs = spark.createDataFrame([(i, "t", None) for i in range(500)] + [(None, None, "a")] * 3, "doc_id long, text string, source string")
    found = Counter(r.source for r in mixing.mixed(docs, temperature=1.0).collect())
    assert 400 < found[None] < 600


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 3), (3, 4)):
        points = {sharding.hilbert_index(p, bits): p for p in itertools.product(range(1 << bits), repeat=dims)}
        assert sorted(points) == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(points[i], points[i + 1])) == 1 for i in range(len(points) - 1))


def test_shards_are_even_and_slots_gapless(spark):
    docs = documents(spark, 4013).union(documents(spark, 10)).withColumn("slot", F.lit(1))
    rows = sharding.assignments(spark, docs).collect()
    assert len(rows) == 4023
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    assert {r.size for r in rows if r.doc_id == 0} == {16}
    out = sharding.sharded(spark, docs)
    assert out.count() == 4023 and set(out.columns) == set(docs.columns) | {"shard"}
    assert sharding.assignments(spark, docs.limit(0)).count() == 0
    assert sharding.assignments(spark, docs.limit(3)).count() == 3


def named(spark, n=4000):
    """Sources that share their first letters, one of which holds a third of all rows."""
    rows = []
    for i in range(n):
        source = None if i % 50 == 0 else "common_crawl_00" if i % 3 == 0 else f"common_crawl_{i * 7 % 12:02d}"
        rows.append((i if i % 41 else None, "w" * (i * i % 997), ["en", "de", "tr", None][i % 4], source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_order_equals_brute_force(spark):
    docs = named(spark)
    rows = [(r.doc_id, r.source, r.lang, len(r.text)) for r in docs.collect()]

    def text_steps(column):
        values = sorted((r[column] for r in rows), key=lambda v: (v is not None, v or ""))
        steps = {v: values.index(v) * 16 // len(values) if v is not None else 0 for v in set(values)}
        used = sorted(set(steps.values()) | {0})
        return {v: used.index(step) for v, step in steps.items()}

    sizes = sorted(r[3] for r in rows)
    cuts = {sizes[math.ceil((i + 1) / 16 * len(sizes)) - 1] for i in range(15)}
    of_source, of_lang = text_steps(1), text_steps(2)
    expected = Counter((sharding.hilbert_index((of_source[s], of_lang[x], sum(n > c for c in cuts)), 4), -1 if i is None else i) for i, s, x, n in rows)
    found = sharding.sharded(spark, docs).orderBy("shard", "slot").collect()
    seen = [(sharding.hilbert_index((of_source[r.source], of_lang[r.lang], sum(len(r.text) > c for c in cuts)), 4), r) for r in found]
    assert Counter((h, -1 if r.doc_id is None else r.doc_id) for h, r in seen) == expected
    assert [h for h, _ in seen] == sorted(h for h, _ in expected.elements())
    assert len(set(of_source.values())) > 8


def test_files_hold_short_ranges(spark, tmp_path):
    import pyarrow.parquet as pq

    sharding.sharded(spark, named(spark)).write.parquet(f"{tmp_path}/out")
    files = [f.read() for f in map(pq.ParquetFile, sorted(str(f) for f in (tmp_path / "out").glob("*.parquet"))) if f.metadata.num_rows]
    assert 30 <= len(files) <= 40
    spans = [(min(x), max(x)) for x in ([v for v in f["source"].to_pylist() if v] for f in files) if x]
    for wanted in ("common_crawl_03", "common_crawl_10"):
        assert 1 <= sum(low <= wanted <= high for low, high in spans) <= len(files) // 3
    assert sum(len(set(f["shard"].to_pylist())) for f in files) / len(files) < 2.5


def test_rows_of_one_id_have_decided_slots(spark):
    docs = spark.createDataFrame([(7, f"t{i % 90}", "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    read = lambda d: Counter((r.text_crc32, r.shard, r.slot) for r in sharding.assignments(spark, d).collect())
    assert read(docs) == read(docs.repartition(5, "text"))


def test_runs_span_few_values(spark):
    docs = documents(spark)
    per_shard = sharding.sharded(spark, docs).groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert sum(r.n for r in per_shard) / len(per_shard) < 3
