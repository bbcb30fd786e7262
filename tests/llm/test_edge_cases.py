"""Clashing and extra columns, repeated rows, empty tables, the pipeline's stages."""

import random

import pytest

import corpus_pipeline
from reliefsignals.llm import queries

CLASHES = ["n", "node", "key", "copy", "shard", "slot", "score", "found", "h", "salt", "base", "part", "other_id", "rate", "mix_key"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables with null, empty, repeated and long texts and clashing columns."""
    rng, path = random.Random(9), tmp_path_factory.mktemp("tables")
    words = ["river", "stone", "green", "walks", "house", "light"]
    item = " ".join(f"b{i}" for i in range(30))
    docs = []
    for i in range(240):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) + ("!!" if bad else "") + str(rng.randrange(40)) for _ in range(rng.choice([8, 60, 200])))
        docs.append([i, text + (f" {item} tail" if i % 29 == 5 else ""), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 5}", len(text)])
    docs += [[300 + k, docs[7][1], "en", "hot", 1] for k in range(12)]
    docs += [[320, None, None, None, None], [321, "", "en", "hot", 0], [322, "w " * 60_000, "en", "s1", 1], [323, "\t", "en", "s1", 1]]
    extra = ", ".join(f"{c} string" for c in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    spark.createDataFrame([(*d, *CLASHES) for d in docs], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 6 == 0 else 1, 0) for i in range(200)] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t}") for c in range(9) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run_on_odd_tables(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    if name.startswith(("op4_", "op5_", "op6_", "op8_", "op9_")):
        assert len(rows) == 256


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run_on_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op2_") else 0)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(spark, stage(spark, docs, folder), "test-stage")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == columns, name
    assert set(docs.columns) >= {"doc_id", "text", "shard", "slot"}
    clean = {i for i in range(240) if i % 6}
    assert clean <= set(kept["quality"]) and not {i for i in range(0, 200, 6)} & set(kept["quality"])
    assert not set(range(300, 312)) & set(kept["near_duplicates"]) and clean <= set(kept["near_duplicates"])
    assert not {i for i in range(240) if i % 29 == 5} & set(kept["decontamination"])
    assert {i for i in clean if i % 29 != 5} <= set(kept["decontamination"])
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and sorted(kept["sharding"]) == sorted(kept["mixing"])


def test_pipeline_of_nothing(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
