"""Operators on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reliefsignals import Dataset, Filters, GeoIndex, overview, prepare
from reliefsignals.operators import aggregates as agg
from reliefsignals.operators import hotspots as hot
from reliefsignals.operators import messages as msg
from reliefsignals.operators.filters import apply_filters, during
from reliefsignals.operators.prepare import unreadable_times

RAW = "id string, tweet string, tweet_clean string, created_at string, province string, district string," \
      " neighborhood string, urgency_score string, pred_saglik string, prob_saglik string," \
      " pred_bilgi_paylasimi string, prob_bilgi_paylasimi string"


def rows(*items):
    base = dict(id="1", tweet="Raw", tweet_clean="su", created_at="2023-02-06 01:10:00", province="Hatay",
                district="Defne", neighborhood="Merkez", urgency_score="2", pred_saglik="1", prob_saglik="0.9",
                pred_bilgi_paylasimi="0", prob_bilgi_paylasimi="0")
    return [tuple({**base, "id": str(i), **item}.values()) for i, item in enumerate(items)]


@pytest.fixture(scope="module")
def make(spark):
    def build(*items, metadata=None, drop=()):
        raw = spark.createDataFrame(rows(*items), RAW).drop(*drop)
        return Dataset.of(prepare(raw, metadata), metadata, "made")

    return build


@pytest.fixture(scope="module")
def index(spark):
    gaz = spark.createDataFrame(
        [("Hatay", "Defne", "merkez", 36.0, 36.0), ("Hatay", "Defne", "merkez", 37.0, 37.0),
         ("Hatay", "Samandağ", "sahil", 35.0, 35.5), ("Kilis", "", "", 30.0, 31.0)],
        "province string, district string, neighborhood_clean string, lat double, lon double")
    return lambda **kw: GeoIndex.build(gaz, **kw)


def test_prepare_rule_and_counts(make):
    rule = "haber alamıyoruz, bilen var mı"
    ds = make(
        dict(tweet_clean=rule, prob_bilgi_paylasimi="0.20", pred_saglik="0.9"),
        dict(tweet_clean=rule, prob_bilgi_paylasimi="0.19", pred_saglik="x"),
        dict(tweet_clean="bilen var mı", prob_bilgi_paylasimi="0.9"),
        dict(tweet_clean="canlı yayın duyurusu", prob_bilgi_paylasimi="0.5"),
        dict(tweet_clean=None, prob_bilgi_paylasimi=None, pred_bilgi_paylasimi=None, urgency_score="bad"),
    )
    got = ds.frame.orderBy("id").select("pred_bilgi_paylasimi", "postprocess_info_v1_added", "pred_label_count",
                                        "pred_any_need", "urgency_score").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, 2.0), (0, 0, 0, 0, 2.0), (0, 0, 1, 1, 2.0), (1, 1, 2, 1, 2.0),
                                      (0, 0, 1, 1, 0.0)]


def test_prepare_optional_columns(spark):
    df = prepare(spark.createDataFrame([("1", "5")], "id string, pred_label_count string"))
    row = df.collect()[0]
    assert (row.pred_label_count, row.pred_any_need, row.date, row.created_at_local) == (5, 1, "", None)
    df = prepare(spark.createDataFrame([("x",)], "pred_any_need string"))
    assert df.collect()[0].pred_any_need == 0
    meta = {"labels": ["health"], "label_to_pred_column": {"health": "flag"}}
    df = prepare(spark.createDataFrame([("1.0",)], "flag string"), meta)
    assert df.collect()[0].flag == 1 and dict(df.dtypes)["flag"] == "bigint"


def test_damaged_flags_do_not_overflow(make):
    row = make(dict(pred_saglik="2147483647", pred_bilgi_paylasimi="2147483647")).frame.first()
    assert (row.pred_saglik, row.pred_label_count, row.pred_any_need) == (2**31 - 1, 2**32 - 2, 1)
    row = make(dict(pred_saglik="9999999999999")).frame.first()
    assert (row.pred_saglik, row.pred_label_count, row.pred_any_need) == (9999999999999, 9999999999999, 1)


def test_unreadable_times_are_counted(make, spark):
    raw = spark.createDataFrame([("02/06/2023 01:17:34",), ("bad",), ("",), (None,), ("13.02.2023",)], "created_at string")
    assert tuple(unreadable_times(raw).first()) == (5, 2, 1)
    assert str(prepare(raw.limit(1)).first().created_at_parsed) == "2023-02-06 01:17:34"
    assert str(prepare(raw.limit(1), day_first=True).first().created_at_parsed) == "2023-06-02 01:17:34"


def test_given_dates_are_kept(spark):
    raw = spark.createDataFrame([("2023-02-06 23:30:00", " 2023-01-01 "), ("bad", None)], "created_at string, date string")
    assert [r.date for r in prepare(raw).collect()] == ["2023-01-01", ""]


def ids(ds, filters):
    return [r.id for r in apply_filters(ds.frame, ds.schema, filters).orderBy("id").collect()]


def test_filters(make):
    ds = make(
        dict(created_at="2023-02-06 22:00:00"),  # local date is the 7th
        dict(created_at="bad", urgency_score="0"),
        dict(province="Kilis", tweet_clean="", tweet="İçme SUYU", pred_bilgi_paylasimi="1"),
        dict(pred_saglik="0", tweet_clean=None, tweet=None),
    )
    day = dt.date(2023, 2, 7)
    assert ids(ds, None) == ids(ds, Filters()) == ["0", "1", "2", "3"]
    assert ids(ds, Filters(start_date=day)) == ["0"]
    assert ids(ds, Filters(end_date=dt.date(2023, 2, 6))) == ["2", "3"]
    assert ids(ds, Filters(provinces=("Kilis",))) == ["2"]
    assert ids(ds, Filters(urgency_min=0)) == ["0", "1", "2", "3"]
    assert ids(ds, Filters(urgency_min=0.5)) == ["0", "2", "3"]
    both = ("saglik", "bilgi_paylasimi")
    assert ids(ds, Filters(labels=both)) == ["0", "1", "2"]
    assert ids(ds, Filters(labels=both, label_mode="all")) == ["2"]
    assert ids(ds, Filters(labels=("unknown",))) == ["0", "1", "2", "3"]
    assert ids(ds, Filters(search=" SUYU ")) == ["2"]
    assert ids(ds, Filters(search="s.")) == [] and ids(ds, Filters(search="  ")) == ["0", "1", "2", "3"]
    assert ids(ds, Filters(search_regex="^S.$")) == ["0", "1"]
    assert ids(ds, Filters(any_need=True)) == ["0", "1", "2"]


def test_filter_mark_equals_filter(make):
    ds = make(dict(), dict(province=None), dict(urgency_score="9"), dict(created_at=None))
    for f in (Filters(urgency_min=3), Filters(provinces=("Hatay",)), Filters(start_date=dt.date(2023, 1, 1))):
        marked = ds.frame.where(f.predicate(ds.frame, ds.schema))
        assert sorted(r.id for r in marked.collect()) == ids(ds, f)


def test_counts(make):
    ds = make(dict(), dict(pred_saglik="0", pred_bilgi_paylasimi="1"), dict(province=""), dict(province="Kilis"))
    assert [(r.label, r["count"]) for r in agg.label_counts(ds).collect()] == [("saglik", 3), ("bilgi_paylasimi", 1)]
    assert sorted((r.province, r["count"]) for r in agg.province_counts(ds).collect()) == [("Hatay", 2), ("Kilis", 1)]
    s = agg.summary(ds, Filters(provinces=("Hatay",))).collect()[0]
    assert (s.total_rows, s.filtered_rows, s.need_signals, s.province_count) == (4, 2, 2, 1)
    assert (s.top_label, s.top_label_count, s.avg_urgency) == ("saglik", 1, 2.0)


def test_empty_selection(make):
    ds = make(dict())
    none = Filters(provinces=("Nowhere",))
    s = agg.summary(ds, none).collect()[0]
    assert (s.total_rows, s.filtered_rows, s.need_signal_rate_pct, s.avg_urgency, s.top_label_count) == (1, 0, 0, 0, 0)
    assert {r["count"] for r in agg.label_counts(ds, none).collect()} == {0}
    assert agg.default_hour(ds, none).collect()[0].hour is None
    assert agg.temporal_daily(ds, none).collect() == [] and agg.hour_label_counts(ds, none).collect() == []


def test_prevalence_uses_declared_figures(make):
    ds = make(dict(), dict(pred_saglik="0"), metadata={"row_count": "10", "pred_positives": {"saglik": 4}})
    got = {r.label: (r.full_positive, r.full_rate_pct, r.filtered_positive, r.filtered_rate_pct)
           for r in agg.prevalence(ds).collect()}
    assert got == {"saglik": (4, 40.0, 1, 50.0), "bilgi_paylasimi": (0, 0.0, 0, 0.0)}


def test_default_hour(make):
    at = "2023-02-06 {:02}:00:00".format
    ds = make(dict(created_at=at(1)), dict(created_at=at(2)), dict(created_at=at(3), pred_saglik="0"),
              dict(created_at=at(3), pred_saglik="0"))
    assert agg.default_hour(ds).collect()[0].hour == "2023-02-06T04:00:00"
    assert agg.default_hour(ds, default="first").collect()[0].hour == "2023-02-06T04:00:00"
    quiet = make(dict(created_at=at(1), pred_saglik="0"), dict(created_at=at(3), pred_saglik="0"),
                 dict(created_at=at(3), pred_saglik="0"))
    assert agg.default_hour(quiet).collect()[0].hour == "2023-02-06T06:00:00"
    moves = agg.hour_cursor(ds).collect()
    assert [r.next_hour[11:13] for r in moves] == ["05", "06", "04"]
    assert [r.previous_hour[11:13] for r in moves] == ["04", "04", "05"]
    assert agg.hour_cursor(ds, wrap=False).collect()[-1].next_hour[11:13] == "06"


def test_missing_place_column(make, index):
    ds = make(dict(), drop=("district",))
    assert hot.hotspots(ds, index(), level="district").collect() == []
    assert hot.hotspots(ds, index()).count() == 1


def test_geocode_chain_and_fan_out(make, index):
    ds = make(
        dict(neighborhood="MERKEZ"),  # two coordinates: two points
        dict(district="Samandağ", neighborhood="other"),  # district mean
        dict(district="Elsewhere", neighborhood="x"),  # province mean
        dict(province="Adana", district="d", neighborhood="x"),  # centroid
        dict(province="Nowhere", district="d", neighborhood="x"),  # no coordinate
        dict(neighborhood=""),  # dropped at this level
    )
    points = {(r.location, r.lat): r for r in hot.hotspots(ds, index(), level="neighborhood").collect()}
    assert {(k[0].split(" / ")[-1], k[1], r.level_used) for k, r in points.items()} == {
        ("MERKEZ", 36.0, "neighborhood"), ("MERKEZ", 37.0, "neighborhood"), ("other", 35.0, "district"),
        ("x", 36.0, "province"), ("x", 37.0, "centroid")}
    stats = hot.hotspot_stats(ds, index(), level="neighborhood").collect()[0]
    assert (stats.hotspots, stats.total_signal) == (5, 5.0) and stats.geo_coverage_pct == 5 / 6 * 100
    strict = hot.hotspot_stats(ds, index(), level="neighborhood", placeable_only=True).collect()[0]
    assert strict.geo_coverage_pct == 5 / 6 * 100  # five points over six placed rows
    single = hot.hotspots(ds, index(dedupe=True), level="neighborhood")
    assert sorted(r.lat for r in single.where("district = 'Defne'").collect()) == [36.5]


def test_large_gazetteer_is_not_broadcast(make, index):
    ds = make(dict(), dict(district="Samandağ", neighborhood="Sahil"), dict(province="Adana"))
    small, large = index(), index(broadcast_bytes=300)
    assert small.small and not large.small

    def points(ix):
        return sorted(tuple(r) for r in hot.hotspots_timeline(ds, ix, level="neighborhood").collect())

    assert points(small) == points(large)


def test_one_missing_axis_is_replaced_by_both(spark, make):
    gaz = spark.createDataFrame([("Adana", "d", "n", 1.0, None)],
                                "province string, district string, neighborhood_clean string, lat double, lon double")
    ds = make(dict(province="Adana", district="d", neighborhood="n"))
    p = hot.hotspots(ds, GeoIndex.build(gaz), level="neighborhood").collect()[0]
    assert (p.lat, p.lon, p.level_used) == (37.0, 35.3213, "centroid")


def test_hotspot_properties(make, index):
    import itertools

    provinces = ["Hatay", "Kilis", "Adana", "Malatya", "Nowhere"]
    items = [dict(province=p, created_at=f"2023-02-06 0{h}:30:00", urgency_score=str(h))
             for p, h, n in itertools.product(provinces, range(3), range(4)) if n <= provinces.index(p) + h]
    ds = make(*items)
    timeline = hot.hotspots_timeline(ds, index()).collect()
    by_hour = {}
    for r in timeline:
        by_hour.setdefault(r.hour, []).append(r)
    for hour, points in by_hour.items():
        assert abs(sum(p.share_pct for p in points) - 100) < 1e-9
        assert sorted(p.rank for p in points) == list(range(1, len(points) + 1))
        ranked = sorted(points, key=lambda p: p.rank)
        assert [(-p.signal, p.province) for p in ranked] == sorted((-p.signal, p.province) for p in points)
        one = hot.hotspots(ds, index(), hour=hour).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, points))
    assert hot.hotspots(ds, index(), hour="1999-01-01T00:00:00").first().hour == agg.default_hour(ds).first().hour
    levels = hot.all_levels(ds, mode="count_rows").groupBy("level").agg(F.sum("signal").alias("s")).collect()
    assert {r.s for r in levels} == {float(len(items))}


def test_during_reads_one_hour(make, index):
    ds = make(dict(created_at="2023-02-06 01:00:00"), dict(created_at="2023-02-06 01:59:59"),
              dict(created_at="2023-02-06 02:00:00"), dict(created_at="bad"))
    one = during(ds, "2023-02-06T04:00:00")
    assert sorted(r.id for r in one.frame.collect()) == ["0", "1"]
    hour = "2023-02-06T04:00:00"
    assert hot.hotspots(one, index()).collect() == hot.hotspots(ds, index(), hour=hour).collect()
    assert hot.hotspots(during(ds, "2023-02-07T04:00:00"), index()).collect() == []


def test_invalid_level_and_mode_fall_back(make, index):
    ds = make(dict(), dict(pred_saglik="0"))
    p = hot.hotspots(ds, index(), level="planet", mode="mood").collect()
    assert [(r.province, r.district, r.signal) for r in p] == [("Hatay", "", 1.0)]


def test_hour_delta_uses_previous_existing_hour(make, index):
    at = "2023-02-06 {:02}:00:00".format
    ds = make(dict(created_at=at(3)), dict(created_at=at(3), province="Nowhere"), dict(created_at=at(5)),
              dict(created_at=at(5)), dict(created_at=at(5)))
    first, second = hot.hour_delta(ds, index()).orderBy("hour").collect()
    assert (first.previous_signal, first.signal_diff, first.previous_zero) == (None, None, False)
    assert (second.previous_signal, second.signal_diff, second.signal_diff_pct) == (1.0, 2.0, 200.0)
    parity = hot.hour_delta(ds, index(), parity=True).orderBy("hour").collect()[1]
    assert (parity.previous_signal, parity.previous_hotspots, parity.hotspots_diff) == (2.0, 2, -1)


def test_messages(make):
    ds = make(
        dict(urgency_score="5", tweet_clean="  a\n b "),
        dict(urgency_score="5", tweet_clean="", tweet="fallback", pred_bilgi_paylasimi="1"),
        dict(urgency_score="1", tweet_clean="x" * 150),
    )
    top = msg.top_messages(ds).collect()
    assert [(r.id, r.text, r.labels) for r in top[:2]] == [
        ("1", "fallback", ["saglik", "bilgi_paylasimi"]), ("0", "a b", ["saglik"])]
    assert top[0].label_names == ["sağlık", "bilgi paylaşımı"]
    with pytest.raises(ValueError):
        msg.top_messages(ds, limit=0)
    line = msg.ticker(ds).collect()
    assert [(r.id, len(r.text)) for r in line] == [("0", 4), ("2", 140)]
    assert msg.message_list(ds, n=2).count() == 2


def test_lists_are_as_long_as_asked(make, spark):
    blank = [dict(urgency_score="9", tweet_clean=" ")] * 60 + [dict(urgency_score="1")] * 240
    ds = make(*blank)
    assert msg.ticker(ds).count() == 18 and msg.ticker(ds, n=250).count() == 240
    assert msg.top_messages(ds, limit=1000).count() == 300


def test_overview_equals_single_operators(make, tmp_path):
    ds = make(dict(), dict(province="Kilis", urgency_score="7"), dict(created_at="bad"), dict(pred_saglik="0"))
    f = Filters(urgency_min=1)
    report = overview(ds, f, folder=str(tmp_path / "sums"))
    pairs = [(report.summary, agg.summary(ds, f)), (report.label_counts, agg.label_counts(ds, f)),
             (report.prevalence, agg.prevalence(ds, f)), (report.temporal, agg.temporal_daily(ds, f)),
             (report.province_map, agg.province_map(ds, f)), (report.hours, agg.hours(ds, f)),
             (report.default_hour, agg.default_hour(ds, f))]
    for one, other in pairs:
        assert sorted(one.collect(), key=str) == sorted(other.collect(), key=str)
    facts = dict(tuple(r) for r in report.source.collect())
    assert facts["kind"] == "custom" and facts["row_count"] is None
    spark = ds.frame.sparkSession
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    bare = overview(ds, f)
    assert sorted(bare.long().collect(), key=str) == sorted(report.long().collect(), key=str)


def test_options_of_an_empty_table(make, spark):
    ds = make(dict())
    empty = Dataset.of(ds.frame.where("false"))
    got = {(r.section, r.item): r.value for r in agg.options(empty).collect()}
    assert got["urgency_range", "max"] == "10.0" and got["rows", "count"] == "0"
    assert got["date_range", "min"] is None and ("province", "name") not in got
