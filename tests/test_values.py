"""Numbers, time stamps, schema discovery."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reliefsignals.functions import clock, numbers
from reliefsignals.functions.labels import label_name
from reliefsignals.schema import Dataset, discover_schema
from reliefsignals.session import run_folder


def test_numbers(one_column):
    cells = ["1.5", " 2 ", "abc", None, "1d", "2F", "3.f ", "nan", "NaN", "1e3", "-0.25", ""]
    assert one_column(numbers.number_or_null, cells) == [1.5, 2, None, None, None, None, None, None, None, 1000, -0.25, None]
    assert one_column(numbers.number_or_null, ["inf", "-Infinity"]) == [float("inf"), float("-inf")]
    assert one_column(numbers.count_or_zero, ["0.9", "1.9", "-1.5", "x", None, "inf", "1e99"]) == [0, 1, -1, 0, 0, 0, 0]


def test_parse_utc_and_local(one_column):
    cells = [
        "2023-02-06 01:17:34",
        "2023-02-06T01:17:34Z",
        "2023-02-06 04:17:34+03:00",
        "2023-02-06",
        "Mon Feb 06 01:17:34 +0000 2023",
        "2023/02/06 01:17:34",
        "04:17:34",
        "bad",
        "",
        None,
        "Feb 6, 2023 01:17:34",
        "02/06/2023 01:17:34",
        "20230206",
        "6 February 2023",
        "Mon, 06 Feb 2023 01:17:34",
        "13.02.2023",
        "00/13/2023",
        "Foo 6, 2023",
    ]
    quake = dt.datetime(2023, 2, 6, 1, 17, 34)
    midnight = dt.datetime(2023, 2, 6)
    expected = [quake, quake, quake, midnight, quake, quake, None, None, None, None]
    expected += [quake, quake, midnight, midnight, quake, dt.datetime(2023, 2, 13), None, None]
    text = [None if e is None else str(e) for e in expected]
    assert one_column(lambda c: F.date_format(clock.parse_utc(c), "yyyy-MM-dd HH:mm:ss"), cells) == text
    local = one_column(lambda c: clock.hour_text(clock.to_local(clock.parse_utc(c))), cells[:4])
    assert local == ["2023-02-06T04:00:00"] * 3 + ["2023-02-06T03:00:00"]


def test_discover_schema():
    columns = ["id", "p_health", "pred_saglik", "prob_saglik", "pred_extra", "pred_any_need", "prob_barinma"]
    meta = {"labels": ["health", "", 3, "saglik"], "label_to_pred_column": {"health": "p_health", "saglik": "gone"}}
    schema = discover_schema(columns, meta)
    assert schema.labels == ("health", "saglik", "barinma", "extra")
    assert schema.pred == {"health": "p_health", "saglik": "pred_saglik", "extra": "pred_extra"}
    assert schema.prob == {"saglik": "prob_saglik", "barinma": "prob_barinma"}
    assert schema.flagged == ("health", "saglik", "extra") and schema.scored == ("saglik", "barinma")
    assert discover_schema(["id"], {"label_to_pred_column": "no map"}).labels == ()


def test_kind_is_stated(spark):
    def kind(metadata, **given):
        return Dataset.of(spark.range(1), metadata, "x.csv", **given).kind

    assert kind({"canonical": True}) == "canonical_final" and kind(None) == "custom"
    assert kind({"kind": "historical", "canonical": True}) == "historical"
    assert kind({"canonical": True}, kind="mine") == "mine"


def test_run_folder_needs_shared_storage(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            run_folder(spark, "x")


def test_label_name(one_column):
    assert one_column(label_name, ["gida_su", "new_kind_x"]) == ["gıda su", "new kind x"]


def test_declared_figures(spark):
    ds = Dataset.of(spark.range(1), {"row_count": "7", "rows_before": "many", "pred_positives": [1]})
    assert ds.declared_int("row_count") == 7
    assert ds.declared_int("rows_before") is None and ds.declared_positives("saglik") is None
