"""Readers, writers, streams, scoring."""

import datetime as dt
import os
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import adapter as A
from reliefsignals import Dataset, Filters, during, load_gazetteer, load_predictions, prepare, publish_predictions, read_published
from reliefsignals.operators import scoring
from reliefsignals.operators.filters import apply_filters
from reliefsignals.sources.predictions import read_cells
from reliefsignals.streaming.hourly import append_to, hourly_signals, open_stream, replay_hourly_signals

SF = "/root/testdata/sf0.001"


def test_csv_traps(spark, tmp_path):
    path = tmp_path / "p.csv"
    text = '﻿id,tweet_clean,province,urgency_score,pred_saglik\r\n1,"two\nlines, ""quoted""",NA,3,1\r\n' \
           "2,,n/a,<NA>,nan\r\n3,None,#N/A N/A,-1.#IND,1\r\n"
    path.write_bytes(text.encode("utf-8"))
    cells = read_cells(spark, str(path), multi_line=True).orderBy("id").collect()
    assert cells[0].id == "1" and cells[0].tweet_clean == 'two\nlines, "quoted"' and cells[0].province is None
    assert all(v is None for r in cells[1:] for v in (r.tweet_clean, r.province, r.urgency_score))
    ds = load_predictions(spark, str(path), multi_line=True)
    assert [(r.urgency_score, r.pred_saglik) for r in ds.frame.orderBy("id").collect()] == [(3, 1), (0, 0), (0, 1)]
    assert ds.kind == "custom" and ds.schema.labels == ("saglik",)


def test_gazetteer_columns(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("province,district,lat,lon\nSanliurfa, Merkez ,37.1,38.7\nHatay,x,bad,36\n", encoding="utf-8")
    assert [tuple(r) for r in load_gazetteer(spark, str(path)).collect()] == [("Şanlıurfa", "Merkez", "", 37.1, 38.7)]


def test_publish_refuses_to_overwrite_and_prunes(spark, tmp_path):
    ds, path = A.signals(spark, SF), str(tmp_path / "out")
    publish_predictions(ds, path)
    with pytest.raises(AnalysisException):
        publish_predictions(ds, path)
    publish_predictions(ds, path, overwrite=True)
    back = read_published(spark, path)
    assert back.frame.count() == ds.frame.count()
    day = Filters(start_date=dt.date(2024, 1, 5), end_date=dt.date(2024, 1, 5))
    one = apply_filters(back.frame, back.schema, day)
    assert one.count() == apply_filters(ds.frame, ds.schema, day).count() > 0
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(one.inputFiles()) >= 1


def test_large_csv_is_split(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("id,tweet_clean\n" + "".join(f"{i},text number {i}\n" for i in range(20_000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        frame = load_predictions(spark, str(path)).frame
        assert frame.rdd.getNumPartitions() > 4 and frame.count() == 20_000
        whole = load_predictions(spark, str(path), multi_line=True).frame
        assert "REBALANCE" in whole._jdf.queryExecution().executedPlan().toString() and whole.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_published_facts_travel(spark, tmp_path):
    meta = {"labels": ["health"], "label_to_pred_column": {"health": "flag"}, "row_count": 3, "kind": "historical"}
    raw = spark.createDataFrame(
        [("1", "0602", 1, "2023-02-06 01:00:00"), ("2", "", 0, "2023-02-05 23:00:00"), ("3", "0603", 1, None)],
        "id string, date string, flag int, created_at string",
    )
    path = str(tmp_path / "out")
    publish_predictions(Dataset.of(prepare(raw, meta), meta, "given"), path)
    back = read_published(spark, path)
    assert (back.kind, back.name, back.declared_int("row_count")) == ("historical", "given", 3)
    assert back.schema.flagged == ("health",)
    assert sorted((r.id, r.date, r.flag) for r in back.frame.collect()) == [("1", "0602", 1), ("2", "", 0), ("3", "0603", 1)]
    hour = during(back, "2023-02-06T04:00:00").frame
    assert [r.id for r in hour.collect()] == ["1"]
    plan = hour._jdf.queryExecution().executedPlan().toString()
    assert "local_day" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]


def test_replay_is_whole_in_any_order(spark, tmp_path):
    """Parts that run backwards in time, one in a micro-batch, and more input later."""
    messages = A.signals(spark, SF).frame.select("created_at_local", "province", "pred_any_need", "urgency_score")
    days = messages.withColumn("d", F.dayofmonth("created_at_local"))

    def write(i, low, high):
        days.where(f"d BETWEEN {low} AND {high}").drop("d").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")

    for i, (low, high) in enumerate([(21, 31), (1, 5)]):
        write(i, low, high)
    parts = open_stream(spark, f"{tmp_path}/in/*", messages.schema, files_per_trigger=1).select(*messages.columns)
    run = f"{tmp_path}/run"
    assert replay_hourly_signals(parts, run).agg(F.sum("n_rows")).first()[0] == days.where("d > 20 OR d < 6").count()
    write(2, 6, 20)
    whole = replay_hourly_signals(parts, run)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, hourly_signals(messages).collect()))


def test_stream_in_time_order_equals_batch(spark, tmp_path):
    messages = A.signals(spark, SF).frame.select("created_at_local", "province", "pred_any_need", "urgency_score")
    days = messages.withColumn("d", F.dayofmonth("created_at_local"))
    for i, (low, high) in enumerate([(1, 10), (11, 20), (21, 31)]):
        days.where(f"d BETWEEN {low} AND {high}").drop("d").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    # The parts are read one by one, in the order in which they were written.
    parts = open_stream(spark, f"{tmp_path}/in/*", messages.schema, files_per_trigger=1)
    replayed = replay_hourly_signals(parts.select(*messages.columns), f"{tmp_path}/run").collect()
    assert sorted(map(tuple, replayed)) == sorted(map(tuple, hourly_signals(messages).collect()))


def test_open_hours_are_held_back(spark, tmp_path):
    messages = A.signals(spark, SF).frame.select("created_at_local", "province", "pred_any_need", "urgency_score")
    messages.write.parquet(f"{tmp_path}/in")
    stream = hourly_signals(open_stream(spark, f"{tmp_path}/in", messages.schema))
    append_to(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = {tuple(r) for r in hourly_signals(messages).collect()}
    assert closed < whole
    assert max(r[0] for r in closed) < max(r[0] for r in whole)


def test_score_batch(spark):
    def load():
        return lambda texts: np.array([[len(t) - 4.0, 0.0] for t in texts])

    df = spark.createDataFrame([(1, " ab  cd "), (2, None), (3, "e\u0301")], "id int, tweet string").repartition(3)
    got = scoring.score_batch(df, load, ["a", "b"], batch_size=1).orderBy("id").collect()
    assert [r.scored_text for r in got] == ["ab cd", "", "\u00e9"]
    expected = [1 / (1 + np.exp(-x)) for x in (1.0, -4.0, -3.0)]
    assert np.allclose([r.prob_a for r in got], expected, atol=1e-7) and {r.prob_b for r in got} == {0.5}
    long = spark.createDataFrame([(1, "w " * 5000 + "end")], "id int, tweet string")
    assert scoring.score_batch(long, lambda: lambda t: np.array([[float(t[0].endswith("end"))]]), ["a"]).first().prob_a > 0.7
    with pytest.raises(Exception, match="3 logits"):
        scoring.score_batch(df, load, ["a", "b", "c"]).collect()


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.zeros((len(texts), 1))

    df = spark.range(200).select(F.col("id").cast("string").alias("tweet")).repartition(40)
    assert scoring.score_batch(df, load, ["a"]).where("prob_a = 0.5").count() == 200
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 40


def test_labels_and_thresholds_must_agree(spark):
    df = spark.createDataFrame([(0.6, 0.1)], "prob_x double, prob_y double")
    for thresholds in ({"x": 0.5}, {"x": 0.5, "y": 0.5, "z": 0.5}):
        with pytest.raises(ValueError, match="without"):
            scoring.apply_thresholds(df, thresholds)


def test_sigmoid_is_stable(one_column):
    got = one_column(scoring.sigmoid, [-1000.0, 0.0, 1000.0, -1.0], "double")
    assert got[:3] == [0.0, 0.5, 1.0] and abs(got[3] - 1 / (1 + np.exp(1))) < 1e-15


def test_postprocess_appends_last(spark):
    df = spark.createDataFrame(
        [(["bilgi_paylasimi"], 0.9, "duyuru"), (["saglik"], 0.2, "DUYURU"), ([], 0.1, "duyuru"), ([], None, "duyuru")],
        "predicted array<string>, prob_bilgi_paylasimi double, scored_text string")
    got = [r.predicted for r in scoring.score_postprocess(df).collect()]
    assert got == [["bilgi_paylasimi"], ["saglik", "bilgi_paylasimi"], [], []]


def test_thresholds_compare_in_single_precision(spark):
    df = spark.createDataFrame([(0.6,), (0.59,), (None,)], "prob_x double")
    got = scoring.apply_thresholds(df, {"x": 0.6000000001}).collect()
    assert [(r.pred_x, r.predicted) for r in got] == [(1, ["x"]), (0, []), (0, [])]
