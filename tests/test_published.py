"""Published tables: versions, sums in the place of messages, search that skips blocks."""

import datetime as dt
import os
import threading
from dataclasses import replace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import adapter as A
from reliefsignals.operators import aggregates as agg
from reliefsignals.operators import hotspots as hot
from reliefsignals.operators import messages as msg
from reliefsignals.operators.filters import Filters, apply_filters, during
from reliefsignals.operators.measures import answered_by_sums
from reliefsignals.schema import Dataset
from reliefsignals.sources import predictions, search
from reliefsignals.sources.predictions import prune_versions, publish_predictions, read_published, replace_days
from reliefsignals.sources.versions import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def signals(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("signals") / "t.parquet")
    A.signals(spark, SF).frame.write.parquet(path)
    return Dataset.of(spark.read.parquet(path))


@pytest.fixture(scope="module")
def table(signals, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("published") / "out")
    publish_predictions(signals, path, search=True)
    return path


def rows(frame):
    return sorted(map(repr, frame.collect()))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def urgent(ds):
    return replace(ds, frame=ds.frame.withColumn("urgency_score", F.lit(9.0)))


# --- versions -------------------------------------------------------------------


def test_readers_see_the_old_version_until_the_commit(spark, signals, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    publish_predictions(signals, path)
    old, n = read_published(spark, path), signals.frame.count()
    seen, stage = [], predictions._stage

    def watched(*args):
        days = stage(*args)
        # Everything is staged, nothing committed.
        seen.append(read_published(spark, path).frame.where("urgency_score = 9").count())
        seen.append(agg.summary(read_published(spark, path)).first().max_urgency)
        return days

    monkeypatch.setattr(predictions, "_stage", watched)
    publish_predictions(urgent(signals), path, overwrite=True)
    assert seen[0] < n and seen[1] == agg.summary(signals).first().max_urgency
    assert read_published(spark, path).frame.where("urgency_score = 9").count() == n
    # A reader that opened the table before still reads its own version.
    assert rows(old.frame.select(signals.frame.columns)) == rows(signals.frame)


def test_a_crash_in_the_middle_leaves_the_old_version(spark, signals, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    publish_predictions(signals, path)
    broken = F.when(F.col("id") == "77", F.raise_error(F.lit("lost"))).otherwise(F.col("tweet"))
    with pytest.raises(Exception, match="lost"):
        publish_predictions(replace(signals, frame=signals.frame.withColumn("tweet", broken)), path, overwrite=True)
    assert rows(read_published(spark, path).frame.select(signals.frame.columns)) == rows(signals.frame)

    def ended(self, *_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", ended)
        with pytest.raises(KeyboardInterrupt):
            publish_predictions(urgent(signals), path, overwrite=True)
    assert rows(read_published(spark, path).frame.select(signals.frame.columns)) == rows(signals.frame)
    gone = prune_versions(spark, path)
    assert gone and rows(read_published(spark, path).frame.select(signals.frame.columns)) == rows(signals.frame)


def test_one_of_two_writers_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    results = []

    def commit(name):
        try:
            results.append(store.commit({"": name}, {}, None).number)
        except AnalysisException:
            results.append("refused")

    writers = [threading.Thread(target=commit, args=(f"v{i}",)) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(results, key=str) == [1, "refused", "refused", "refused"]
    first = store.current()
    os.close(os.open(f"{tmp_path}/s/claims/2", os.O_CREAT))
    with pytest.raises(AnalysisException):
        store.commit({}, {}, first)
    store.release()
    assert store.commit({"": "w"}, {}, first).number == 2 and store.current().days == {"": "w"}


def test_replaced_days_change_alone(spark, signals, tmp_path):
    path = str(tmp_path / "out")
    publish_predictions(signals, path, search=True)
    before = Store(spark, path).current()
    picked = F.col("created_at_local").cast("date") == "2024-01-10"
    changed = signals.frame.where(picked & (F.col("urgency_score") < 5)).withColumn("urgency_score", F.lit(40.0))
    replace_days(replace(signals, frame=changed), path)
    now = Store(spark, path).current()
    assert {d for d in now.days if now.days[d] != before.days.get(d)} == {"2024-01-10"}
    want = Dataset.of(signals.frame.where(~picked).unionByName(changed))
    back = read_published(spark, path)
    assert rows(back.frame.select(signals.frame.columns)) == rows(want.frame)
    for f in (None, Filters(provinces=("ASIA",)), Filters(labels=("saglik",))):
        assert rows(agg.summary(back, f)) == rows(agg.summary(want, f))
    with pytest.raises(AnalysisException):
        replace_days(replace(signals, frame=changed.drop("tweet")), path)


# --- sums -------------------------------------------------------------------------


ANSWERED = [None, Filters(), Filters(provinces=("ASIA", "EUROPE"), districts=("NATION_8",)), Filters(start_date=dt.date(2024, 1, 4), end_date=dt.date(2024, 1, 9), search="  ")]
OTHERS = [Filters(labels=("saglik",)), Filters(urgency_min=3.0), Filters(any_need=True), Filters(search="haber"), Filters(search_regex="su ve")]


@pytest.mark.parametrize("filters", ANSWERED + OTHERS, ids=repr)
def test_sums_answer_what_they_can_and_nothing_else(spark, signals, table, filters):
    ds, index = read_published(spark, table), A.geo_index(spark, SF)
    assert answered_by_sums(ds, filters) == (filters in ANSWERED)
    operators = [
        lambda x: hot.hotspots(x, index, filters, level="neighborhood"),
        lambda x: hot.hotspots(x, index, filters, hour="2024-01-10T05:00:00", mode="sum_urgency"),
        lambda x: hot.hotspots_timeline(x, index, filters),
        lambda x: agg.hours(x, filters),
        lambda x: agg.default_hour(x, filters),
        lambda x: agg.summary(x, filters),
        lambda x: agg.temporal_daily(x, filters),
        lambda x: agg.prevalence(x, filters),
    ]
    for operator in operators if filters in ANSWERED else operators[2:6:3]:
        found = operator(ds)
        if filters in ANSWERED:
            assert "/messages" not in plan(found) and "/sums" in plan(found)
        assert rows(found) == rows(operator(signals))


def test_sums_stand_for_the_whole_table_only(spark, table):
    ds = read_published(spark, table)
    part = during(ds, "2024-01-10T05:00:00")
    assert not answered_by_sums(part, None)
    assert agg.summary(part).first().total_rows == part.frame.count() < ds.frame.count()


# --- search -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """20,000 messages over ten days; one rare word each in two neighbouring rows, one after the other in time."""
    path = str(tmp_path_factory.mktemp("texts") / "out")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40)
    word = F.element_at(F.split(F.lit("su gıda çadır yol köprü ekip ilaç elektrik"), " "), (F.col("id") % 8 + 1).cast("int"))
    rare = F.when(F.col("id").isin(7001, 7002), "xylofon STRASSE ").when(F.col("id") == 19_999, "ﬁxage ").otherwise("")
    frame = spark.range(20_000).select(
        F.col("id").cast("string").alias("id"), F.concat(rare, F.lit("Mahallede "), word, F.lit(" lazım "), F.col("id") % 97).alias("tweet_clean"),
        F.when(F.col("id") % 5000 != 3, at.cast("timestamp_ntz")).alias("created_at_local"),
    ).withColumn("date", F.date_format("created_at_local", "yyyy-MM-dd"))
    size = search.BLOCK_BYTES
    search.BLOCK_BYTES = 4_096
    try:
        publish_predictions(Dataset.of(frame), path, search=True)
    finally:
        search.BLOCK_BYTES = size
    return path, frame


def files_read(frame):
    """Files that the scan of the messages opened, from its metrics, which hold for a first run only."""
    frame = frame.select("*")
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    # An empty choice is planned away.
    return leaf.metrics().apply("numFiles").value() if leaf.metrics().contains("numFiles") else 0


def test_few_blocks_for_a_rare_word_all_for_a_common_one(spark, texts):
    path, frame = texts
    ds = read_published(spark, path)
    whole, total = ds.signatures.count(), ds.signatures.agg(F.sum("n_rows")).first()[0]
    assert total == 20_000 and whole > 100
    found = {}
    for word in ("xylofon", "straße", "FIXAGE", "mahallede", "köprü", "köprü lazım 9", "nowhere", "zz", "la"):
        f = Filters(search=word)
        part = search.narrowed(ds, f)
        got = apply_filters(part.frame, part.schema, f)
        want = apply_filters(frame, ds.schema, f)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), word
        found[word] = search.blocks_for(ds, f).count(), files_read(got)
    every = files_read(ds.frame)
    assert found["xylofon"][0] <= 2 and found["straße"][0] <= 2 and found["FIXAGE"][0] == 1 and found["nowhere"] == (0, 0)
    assert found["xylofon"][1] == 1 < every
    assert found["mahallede"][0] == whole and found["mahallede"][1] == every == found["zz"][1]


def test_search_reads_blocks_through_the_operators(spark, texts):
    path, frame = texts
    ds, f = read_published(spark, path), Filters(search="xylofon")
    assert agg.hours(ds, f).count() == 1 and agg.summary(ds, f).first().filtered_rows == 2
    top = msg.top_messages(ds, f)
    assert sorted(r.id for r in top.collect()) == ["7001", "7002"]


def test_common_words_are_not_named_in_plans(spark, texts, monkeypatch):
    ds = read_published(spark, texts[0])
    monkeypatch.setattr(search, "MOST_BLOCKS", 3)
    assert search.narrowed(ds, Filters(search="mahallede")) is ds
    assert search.narrowed(ds, Filters(search="xylofon")) is not ds
    assert search.narrowed(replace(ds, signatures=None), Filters(search="xylofon")).frame is ds.frame


def test_ranges_are_joined_across_the_smallest_gaps():
    spans = [(1, 2), (2, 3), (10, 11), (12, 20), (40, 41)]
    assert search._ranges(spans, 9) == [(1, 3), (10, 11), (12, 20), (40, 41)]
    assert search._ranges(spans, 3) == [(1, 3), (10, 20), (40, 41)]
    assert search._ranges(spans, 1) == [(1, 41)]
