"""The plans are the ones meant: what is scanned, joined, shuffled, sorted."""

import datetime as dt
import re

from checks import adapter as A
from checks.queries import QUERIES
from reliefsignals import Filters
from reliefsignals.operators import aggregates as agg
from reliefsignals.operators import hotspots as hot
from reliefsignals.operators.filters import apply_filters, during
from reliefsignals.schema import Dataset

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"clean_text", "score_batch", "score_postprocess"}


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return initial(df).split("Initial Plan")[0]


def published(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    A.signals(spark, SF).frame.write.parquet(path)
    return Dataset.of(spark.read.parquet(path))


def test_only_text_composition_and_models_use_python(spark):
    streams = {"stream_clean", "stream_hourly_signals", "stream_closed_hours", "stream_hotspots", "load_predictions", "publish_predictions", "load_gazetteer"}
    streams |= {"overview", "hotspots_known_hour", "provenance_published"}
    streams |= {"filter_search_published", "hotspots_published", "summary_published", "replaced_days"}
    for name in set(QUERIES) - PYTHON_QUERIES - streams:
        assert "Python" not in initial(QUERIES[name](spark, SF)), name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    ds = published(spark, tmp_path)
    f = Filters(provinces=("ASIA",), districts=("NATION_8",), urgency_min=2.0)
    plan = initial(apply_filters(ds.frame, ds.schema, f).select("id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert "GreaterThanOrEqual(urgency_score,2.0)" in pushed[1]
    assert "EqualTo(province,ASIA)" in pushed[1] and "EqualTo(district,NATION_8)" in pushed[1]
    assert pushed[2] == "id:string,province:string,district:string,urgency_score:double"


def test_reports_scan_once(spark, tmp_path):
    ds = published(spark, tmp_path)
    f = Filters(start_date=dt.date(2024, 1, 5))
    for operator in (agg.summary, agg.prevalence):
        assert initial(operator(ds, f)).count("FileScan") == 1
    assert initial(agg.options(ds)).count("FileScan") == 1
    assert initial(hot.all_levels(ds)).count("FileScan") == 1


def test_options_expand_places_not_messages(spark, tmp_path):
    """The rows that grouping sets multiply come from an aggregation, never from the scan itself."""
    plan = initial(agg.options(published(spark, tmp_path)))
    below = plan[plan.index("Expand") :]
    assert below.index("HashAggregate") < below.index("FileScan") and below.index("Exchange hashpartitioning(province") < below.index("FileScan")


def test_hour_choice_shares_the_aggregation(spark, tmp_path):
    ds = published(spark, tmp_path)
    index = A.geo_index(spark, SF)
    for mode in hot.MODES:
        plan = final(hot.hotspots(ds, index, level="neighborhood", mode=mode))
        assert len(re.findall(r"ReusedExchange \[hour", plan)) == 1, mode


def test_small_dimensions_are_broadcast(spark):
    plan = initial(QUERIES["hotspots_timeline"](spark, SF))
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lists_are_top_k(spark):
    for name in ("top_messages", "ticker", "message_list"):
        assert "TakeOrderedAndProject" in initial(QUERIES[name](spark, SF))


def test_messages_are_summed_before_any_window(spark, tmp_path):
    plan = initial(hot.hotspots_timeline(published(spark, tmp_path), A.geo_index(spark, SF), level="neighborhood"))
    below_window = plan[plan.rindex("Window"):]
    assert "HashAggregate" in below_window and "partial_sum" in below_window
    assert plan.count("Exchange hashpartitioning(hour") == 2


def test_row_operators_do_not_shuffle(spark):
    for name in ("labels_long", "score_detail", "row_labels", "fix_mojibake", "coerce_numeric", "filter_combined"):
        assert "Exchange hashpartitioning" not in initial(QUERIES[name](spark, SF)), name


def test_a_known_hour_is_pushed_to_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    one = during(published(spark, tmp_path), "2024-01-10T05:00:00")
    plan = initial(hot.hotspots(one, A.geo_index(spark, SF)))
    asked = published(spark, tmp_path / "again")
    for operator in (hot.hotspots, hot.hotspot_stats):
        requested = initial(operator(asked, A.geo_index(spark, SF), hour="2024-01-10T05:00:00"))
        below = requested[requested.index("HashAggregate(keys=[hour"):]
        assert "GreaterThanOrEqual(created_at_local,2024-01-10T05:00)" in below
        missing = initial(operator(asked, A.geo_index(spark, SF), hour="1999-01-01T00:00:00"))
        assert "GreaterThanOrEqual(created_at_local" not in missing
    assert "GreaterThanOrEqual(created_at_local,2024-01-10T05:00)" in plan
    assert "LessThan(created_at_local,2024-01-10T06:00)" in plan
