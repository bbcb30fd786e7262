"""Quantiles without a group in one task, audited duplicates, batches by length, a stored gazetteer."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import adapter as A
from checks.queries import QUERIES
from reliefsignals import Dataset, GeoIndex
from reliefsignals.operators import hotspots as hot
from reliefsignals.operators import scoring
from reliefsignals.operators.duplicates import content_hash, duplicate_check, duplicate_counts, without_duplicates
from reliefsignals.operators.geocode import geocode, store_index
from reliefsignals.operators.quantiles import group_quantiles, value_range

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- quantiles ----------------------------------------------------------------


def test_group_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    groups = {
        "hot": [float(x) for x in rng.integers(1, 9, 3000)],
        "wide": [float(x) for x in 10 ** rng.uniform(-300, 300, 400)],
        "close": [float(x) for x in 1000 + rng.random(400) / 1e6],
        "signed": [float(x) for x in rng.normal(0, 5, 301)] + [0.0] * 40,
        "one": [7.5],
        "two": [1.0, 2.0],
        None: [3.0, 4.0, 8.0, None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    quantiles = [0.95, 0.8, 0.5, 0.0, 1.0, 1 / 3]
    got = {r["group"]: r for r in group_quantiles(df, "g", "v", quantiles).collect()}
    want = df.where("g IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in quantiles])).alias("cuts"), F.count("v").alias("n"), F.sum("v").alias("total"))
    rows = want.collect()
    assert set(got) == set(groups) - {None}
    for r in rows:
        assert got[r.g].cuts == r.cuts and got[r.g]["values"] == r.n, r.g
        assert got[r.g].total == pytest.approx(r.total, rel=1e-9)


def test_group_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g string, v double")
    assert group_quantiles(empty, "g", "v", [0.5]).collect() == []
    assert group_quantiles(empty.where("g = 'b'"), "g", "v", [0.5]).collect() == []


def test_ranges_never_fall(spark, one_column):
    values = sorted([0.0, 5e-324, 1e-310, 1e308, 1.0, 2.0, 2.0000000000000004, -1e308, -3.0, -5e-324, *np.random.default_rng(1).normal(0, 100, 500).tolist()])
    ranges = one_column(value_range, values + [float("inf"), float("nan")], "double")
    assert ranges == sorted(ranges) and ranges[-1] > ranges[-2] > 0
    signs = {(np.sign(v), np.sign(r)) for v, r in zip(values, ranges)}
    assert signs == {(-1, -1), (0, 0), (1, 1)}


def test_severity_has_no_percentile_over_a_window(spark):
    plan = plan_of(QUERIES["hotspot_severity"](spark, SF))
    assert "percentile" not in plan
    # The running sums see values and ranges. Nobody asks for ranks here, so no window holds points.
    windows = [x for x in plan.splitlines() if re.search(r"[-+] Window ", x)]
    assert len(windows) >= 2 and all("signal" not in x and "row_number" not in x for x in windows)


def test_large_groups_rank_the_same(spark):
    ds, index = A.signals(spark, SF), A.geo_index(spark, SF)
    for mode in ("count_rows", "sum_urgency"):
        usual = hot.hotspots_timeline(ds, index, None, "district", mode)
        large = hot.hotspots_timeline(ds, index, None, "district", mode, large_groups=True)
        assert sorted(map(str, large.collect())) == sorted(map(str, usual.collect()))


# --- duplicates ---------------------------------------------------------------

ROWS = [
    (1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x"), (5, None, "x"), (6, "", "x"), (7, "b", None),
    (8, "b", "x"), (9, None, None),
]


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame(ROWS, "id int, text string, source string").repartition(3)


def test_duplicate_counts(spark, copies):
    assert tuple(duplicate_counts(copies, ["text"]).first()) == (9, 4, 5, 3)
    assert tuple(duplicate_counts(copies, ["text", "source"]).first()) == (9, 7, 2, 2)
    assert tuple(duplicate_counts(copies.where("id > 99"), ["text"]).first()) == (0, 0, 0, 0)


def test_hash_tells_null_from_a_shift(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "x string, y string")
    assert df.select(content_hash(["x", "y"])).distinct().count() == 3


def test_without_duplicates_keeps_first_ids(spark, copies):
    assert sorted(r.id for r in without_duplicates(copies, ["text"]).collect()) == [1, 4, 6, 7]
    kept = without_duplicates(copies, ["text", "source"])
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9] and kept.columns == copies.columns
    unnamed = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (3, "b"), (None, "c")], "id int, text string")
    assert sorted(map(str, without_duplicates(unnamed, ["text"]).collect())) == sorted(
        ["Row(id=None, text='a')"] * 2 + ["Row(id=3, text='b')", "Row(id=None, text='c')"]
    )


def test_contents_of_one_hash_stay_apart(spark, copies, monkeypatch):
    """With a hash that is the same for all, the comparison of contents still decides."""
    monkeypatch.setattr("reliefsignals.operators.duplicates.content_hash", lambda columns: F.lit(1).cast("long"))
    assert tuple(duplicate_counts(copies, ["text"]).first()) == (9, 4, 5, 3)
    assert sorted(r.id for r in without_duplicates(copies, ["text"]).collect()) == [1, 4, 6, 7]


def test_duplicate_check_lines(spark, copies):
    facts = {"rows_before": 9, "rows_after": 8, "duplicate_rows_removed": 5}
    after = Dataset.of(without_duplicates(copies, ["text", "source"]), facts)
    got = {r.item: tuple(r)[1:] for r in duplicate_check(after, ["text"], copies).collect()}
    assert got == {
        "rows_before": (9, 9, False),
        "rows_after": (7, 8, True),
        "duplicate_rows_removed": (5, 5, False),
        "duplicate_rows_left": (3, 0, True),
    }
    alone = {r.item: tuple(r)[1:] for r in duplicate_check(Dataset.of(after.frame), ["text"]).collect()}
    assert alone["rows_before"] == (None, None, False) and alone["duplicate_rows_left"] == (3, None, False)


def test_only_hashes_are_shuffled_first(spark, copies):
    plan = plan_of(duplicate_counts(copies, ["text"]))
    first = [x for x in plan.splitlines() if "Exchange hashpartitioning(_hash" in x]
    assert first and "partial_count" in plan


# --- batches by length --------------------------------------------------------


def test_batches_hold_every_text_once_and_bound_padding():
    batches = scoring.length_batches()
    sizes = np.array([5, 0, 900, 3, 3, 40, 41, 7])
    for size, cells in [(1, None), (3, None), (100, None), (4, 100), (4, 1)]:
        parts = list(batches(sizes, size, cells))
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(sizes)))
        for part in parts:
            assert len(part) <= size
            assert cells is None or len(part) == 1 or sizes[part].max() * len(part) <= cells
    assert list(batches(np.array([], np.int64), 4)) == []


def test_padding_work_falls(spark):
    """Characters a model reads with padding, for the documents as they come and by length."""
    sizes = np.array([r[0] for r in A.table(spark, SF.replace("0.001", "0.01"), "documents").orderBy("doc_id").selectExpr("length(text)").na.fill(0).collect()])

    def padded(parts):
        return sum(int(sizes[p].max()) * len(p) for p in parts)

    arrival = padded(np.arange(i, min(i + 64, len(sizes))) for i in range(0, len(sizes), 64))
    sorted_work = padded(scoring.length_batches()(sizes, 64))
    assert sizes.sum() <= sorted_work < arrival / 3


def test_scores_keep_their_rows(spark):
    def load():
        def model(texts):
            # Seen together: the longest text of the batch stands in the second logit.
            return np.array([[len(t) / 100.0, max(map(len, texts)) / 100.0] for t in texts])

        return model

    rows = [(i, "w" * (i * 37 % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, tweet string").coalesce(1)
    got = scoring.score_batch(df, load, ["own", "longest"], batch_size=10, batch_cells=600).collect()
    assert [r.id for r in got] == [i for i, _ in rows]
    own = [1 / (1 + np.exp(-len(t) / 100.0)) for _, t in rows]
    assert np.allclose([r.prob_own for r in got], own, atol=1e-6)
    padding = [r.prob_longest - r.prob_own for r in got]
    assert min(padding) > -1e-6 and max(padding) < 0.02


# --- stored gazetteer ---------------------------------------------------------


@pytest.fixture
def skewed(spark, tmp_path):
    """A gazetteer of which one province and one district hold most places, and places of many hours."""
    towns = [("A", f"D{i % 3 if i > 60 else 0}", f"n{i}", 36.0 + i / 64, 35.0 + i / 32) for i in range(90)]
    towns += [("B", "D9", "n1", 40.0, 41.0), ("B", "D9", "n1", 40.5, 41.5), ("C", "", "", 38.0, 39.0)]
    gaz = spark.createDataFrame(towns, "province string, district string, neighborhood_clean string, lat double, lon double")
    names = [("A", f"D{i % 4}", f"N{i % 100}") for i in range(400)] + [("B", "D9", "N1"), ("B", "D8", "x"), ("C", "?", "?"), ("Z", "", "q"), ("A", "D0", "")]
    rows = [(h, *n, float(h)) for h in range(5) for n in names]
    places = spark.createDataFrame(rows, "hour int, province string, district string, neighborhood string, signal double")
    places.write.parquet(f"{tmp_path}/places")
    return GeoIndex.build(gaz, {"Z": (1.0, 2.0)}), spark.read.parquet(f"{tmp_path}/places")


@pytest.mark.parametrize("level", ["neighborhood", "district", "province"])
def test_stored_index_gives_the_same(spark, tmp_path, skewed, level):
    index, places = skewed
    stored = store_index(index, f"{tmp_path}/gaz", f"g_{uuid.uuid4().hex}", salts=4)
    assert sorted(map(str, geocode(places, level, stored).collect())) == sorted(map(str, geocode(places, level, index).collect()))
    assert geocode(places, level, stored).columns == geocode(places, level, index).columns


def test_stored_gazetteer_is_not_shuffled(spark, tmp_path, skewed):
    index, places = skewed
    stored = store_index(index, f"{tmp_path}/gaz", f"g_{uuid.uuid4().hex}", salts=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(geocode(places, "neighborhood", stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Bucketed: true") == 3
    # Three exchanges, all of places: from a bucketed scan up to its join there is none.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    for part in plan.split("Bucketed: true")[:3]:
        below_join = part[part.rindex("Sort ["):]
        assert "Exchange" not in below_join


def test_hot_keys_are_dealt_over_salts(spark, tmp_path, skewed):
    index, places = skewed
    stored = store_index(index, f"{tmp_path}/gaz", f"g_{uuid.uuid4().hex}", salts=4)
    dealt = spark.table(stored.tables["districts"])
    assert dealt.groupBy("province", "district").count().where("count != 4").count() == 0
    plain = index.gazetteer.groupBy("province", "district").count().count()
    assert dealt.count() == 4 * plain


def test_metadata_only_figures_stay(spark):
    """The older check echoes the declared figures beside its own lines, as before."""
    assert {"rows_before", "duplicate_rows_removed"} <= set(QUERIES["provenance_check"](spark, SF).columns)
    assert hot.MODES[0] == "count_rows"
