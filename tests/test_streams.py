"""Streams with state: hours that close, rankings kept up to date."""

import datetime as dt
import os

from pyspark.sql import functions as F

from checks import adapter as A
from reliefsignals.operators import hotspots as hot
from reliefsignals.schema import Dataset
from reliefsignals.streaming.closing import close_hours, hours_so_far
from reliefsignals.streaming.hourly import open_stream
from reliefsignals.streaming.ranking import compacted_to, current_ranking, drop_compacted, rank_hourly

SF = "/root/testdata/sf0.001"
SCHEMA = "created_at_local timestamp_ntz, province string, pred_any_need int, urgency_score double"


def test_hours_close_late_rows_count_and_none_is_lost(spark, tmp_path):
    day = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    parts = [
        [(day(1, 5), "P", 1, 2.0), (day(1, 5, 30), None, 0, None), (None, "P", 1, 9.0), (day(1, 6), "P", None, 1.0)],
        [(day(3, 0), "P", 1, 1.0), (day(1, 6, 59), "P", 1, 4.0)],
        # Far behind the watermark, each a kind of its own: an hour that closed, one never seen, one before all bounds.
        [(day(1, 5, 1), "P", 1, 8.0), (day(1, 2), "P", 1, 16.0), (dt.datetime(1901, 1, 1), "P", 0, 0.5)],
        # A wrong clock: the watermark stops at the last bound, and nothing after it is dropped.
        [(dt.datetime(2180, 1, 1), "P", 0, 3.0)],
        [(day(4, 0), "P", 1, 32.0)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = open_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema)
        close_hours(stream.select("created_at_local", "province", "pred_any_need", "urgency_score"), f"{tmp_path}/run", parts=2).awaitTermination()
    found = {(r.hour, r.province): (r.n_rows, r.n_need_rows, r.urgency, r.late_rows, r.open) for r in hours_so_far(spark, f"{tmp_path}/run").collect()}
    assert found == {
        ("2024-01-01T05:00:00", "P"): (2, 2, 10.0, 1, False),
        ("2024-01-01T05:00:00", None): (1, 0, None, 0, False),
        ("2024-01-01T06:00:00", "P"): (2, 1, 5.0, 0, False),
        ("2024-01-03T00:00:00", "P"): (1, 1, 1.0, 0, False),
        ("2024-01-01T02:00:00", "P"): (1, 1, 16.0, 1, False),
        ("1901-01-01T00:00:00", "P"): (1, 0, 0.5, 1, False),
        ("2180-01-01T00:00:00", "P"): (1, 0, 3.0, 0, True),
        ("2024-01-04T00:00:00", "P"): (1, 1, 32.0, 1, False),
    }


def test_ranking_follows_the_stream_and_ranks_changed_hours_only(spark, tmp_path):
    columns = ("created_at_local", "province", "district", "pred_any_need", "urgency_score")
    messages = A.signals(spark, SF).frame.select(*columns).withColumn("d", F.dayofmonth("created_at_local"))
    index, folder = A.geo_index(spark, SF), f"{tmp_path}/run"
    seen = None
    steps = [("d <= 9", 0), ("d BETWEEN 10 AND 12 AND urgency_score < 5", 1), ("d BETWEEN 11 AND 12 AND urgency_score >= 5", 2), ("d > 25", 3)]
    for rule, i in steps:
        new = messages.where(rule).drop("d")
        seen = new if seen is None else seen.union(new)
        new.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = open_stream(spark, f"{tmp_path}/in/*", new.schema).select(*columns)
        rank_hourly(stream, folder, index, level="district", compact_every=3).awaitTermination()
        expected = hot.hotspots_timeline(Dataset.of(seen), index, level="district")
        assert sorted(map(tuple, current_ranking(spark, folder).collect())) == sorted(map(tuple, expected.collect()))
    ranked = {n: {r.hour[:10] for r in spark.read.parquet(f"{folder}/ranked/batch={n}").select("hour").distinct().collect()} for n in range(4)}
    assert {h for h in ranked[2]} <= {"2024-01-11", "2024-01-12"} and min(ranked[3]) > "2024-01-25"
    assert compacted_to(spark, folder) == 2
    before = sorted(map(tuple, current_ranking(spark, folder).collect()))
    drop_compacted(spark, folder)
    assert [os.listdir(f"{folder}/{t}") for t in ("sums", "ranked", "changed")] == [["batch=3"]] * 3
    assert sorted(map(tuple, current_ranking(spark, folder).collect())) == before
    # A compaction that was cut off before its last table is not used.
    os.makedirs(f"{folder}/compacted/upto=3/sums")
    assert compacted_to(spark, folder) == 2
