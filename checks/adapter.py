"""Given tables seen as the tables the operators expect (FIXTURES.md, part B)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.operators.geocode import GeoIndex
from reliefsignals.operators.prepare import apply_info_rule, count_labels
from reliefsignals.schema import Dataset, discover_schema
from reliefsignals.session import configure, run_folder

CENTROIDS = {"MIDDLE EAST": (36.5, 38.25)}
LABELS = fv.DEFAULT_LABELS


# Stated, so that no job has to read them from the files.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A run folder; where no shared one is named, a temporary one, in local mode only."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local["):
        return run_folder(spark, name)
    return f"{tempfile.mkdtemp(prefix='reliefsignals-')}/{name}-{uuid.uuid4().hex}"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


_TEXTS = """element_at(array(
  'haber alamıyoruz, bilen var mı',
  'ulaşılamıyor, telefon 05551234567',
  'duyan bilen irtibat kursun',
  'duyuru: yardım dağıtım noktası',
  'çadıra ihtiyaç var',
  'su ve gıda lazım',
  NULL,
  ''), cast(event_id % 8 + 1 AS int))"""


def signals_from(events: DataFrame, places: DataFrame) -> DataFrame:
    """The prediction table B1, typed, before post-processing.  ``events`` may be a stream."""
    joined = events.join(places, F.expr("n_nationkey = user_id % 25")).selectExpr(
        "*", "cast(get_json_object(props, '$.k') AS bigint) AS k", "ts + INTERVAL 3 HOURS AS created_at_local"
    )
    base = joined.selectExpr(
        "cast(event_id AS string) AS id",
        "concat('raw ', event_id) AS tweet",
        f"{_TEXTS} AS tweet_clean",
        "created_at_local",
        "date_format(created_at_local, 'yyyy-MM-dd') AS date",
        "date_format(created_at_local, 'HH:mm:ss') AS time",
        "if(event_id % 17 = 0, '', r_name) AS province",
        "if(event_id % 13 = 0, '', n_name) AS district",
        "if(event_id % 10 = 0, '', concat('N', user_id % 7)) AS neighborhood",
        "cast(floor(value / 50D) AS double) AS urgency_score",
        *[f"((k * {2 * i + 3} + event_id * {i + 1}) % 100) / 100D AS prob_{x}" for i, x in enumerate(LABELS)],
    )
    return base.selectExpr(
        "*", *[f"cast(prob_{x} >= {fv.THRESHOLDS[x]!r}D AS int) AS pred_{x}" for x in LABELS]
    )


def finish(signals: DataFrame) -> DataFrame:
    """Post-process rule and label counts on the typed table."""
    return count_labels(apply_info_rule(signals), discover_schema(signals.columns))


def plain_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_from(table(spark, sf_dir, "events"), _places(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str, metadata: dict | None = None) -> Dataset:
    return Dataset.of(finish(plain_signals(spark, sf_dir)), metadata, "signals")


def raw_cells_from(events: DataFrame, places: DataFrame) -> DataFrame:
    """The same messages as untyped, dirty cells: what a raw CSV holds."""
    s = signals_from(events, places).withColumn("n", F.col("id").cast("bigint"))
    n = F.col("n")
    utc = F.col("created_at_local") - F.expr("INTERVAL 3 HOURS")

    def cycle(by: int, *cells: Column | str | None) -> Column:
        options = [c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells]
        return F.element_at(F.array(*options), (n % by + 1).cast("int"))

    created = cycle(
        7,
        F.date_format(utc, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(utc, "yyyy-MM-dd HH:mm:ss'+00:00'"),
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(utc, "yyyy-MM-dd"),
        F.date_format(F.col("created_at_local"), "yyyy-MM-dd HH:mm:ss'+03:00'"),
        "not a date",
        None,
    )
    province = cycle(
        11,
        F.col("province"),
        " N/A ",
        "Unknown",
        "<NA>",
        "Kahramanmara\u00c5\u009f",
        "Sanliurfa",
        "DiyarbakÄ±r ",
        "\u00c3 tek",
        "Gaziantep \ufffd",
        "Adıyaman",
        None,
    )
    urgency = F.col("urgency_score").cast("string")
    pred = F.col("pred_saglik").cast("string")
    prob = F.col("prob_saglik").cast("string")
    dirty = {
        "urgency_score": cycle(6, urgency, F.concat(F.lit(" "), urgency), "abc", None, "1d", "nan"),
        "pred_saglik": cycle(5, pred, F.concat(pred, F.lit(".9")), "x", None, "0.9"),
        "prob_saglik": cycle(4, prob, "2f", "NaN", None),
    }
    kept = [f"{p}_{x}" for x in LABELS for p in ("pred", "prob") if x != "saglik"]
    return s.select(
        "id",
        "tweet",
        "tweet_clean",
        created.alias("created_at"),
        province.alias("province"),
        cycle(3, F.col("district"), F.concat(F.lit("\t"), F.col("district"), F.lit("\u3000")), "None").alias("district"),
        F.col("neighborhood"),
        *[v.alias(c) for c, v in dirty.items()],
        *[F.col(c).cast("string").alias(c) for c in kept],
    )


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_cells_from(table(spark, sf_dir, "events"), _places(spark, sf_dir))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer B2."""
    covered = _places(spark, sf_dir).where("n_nationkey % 6 != 5 AND n_regionkey != 4")
    j = covered.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    return j.select(
        F.col("r_name").alias("province"),
        F.col("n_name").alias("district"),
        F.concat(F.lit("n"), F.col("j").cast("string")).alias("neighborhood_clean"),
        (F.lit(36.0) + F.col("n_nationkey") * F.lit(0.0625) + F.col("j") * F.lit(0.015625)).alias("lat"),
        (F.lit(35.0) + F.col("n_nationkey") * F.lit(0.125) + F.col("j") * F.lit(0.03125)).alias("lon"),
    )


def customer_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer that grows with the tables: every customer is a place in its nation.

    Coordinates are multiples of 1/64, so their sums are exact; places repeat.
    """
    customers = table(spark, sf_dir, "customer")
    return customers.join(_places(spark, sf_dir), F.expr("n_nationkey = c_nationkey")).selectExpr(
        "r_name AS province",
        "if(c_custkey % 9 = 0, '', n_name) AS district",
        "lower(concat(c_mktsegment, ' ', c_custkey % 41)) AS neighborhood_clean",
        "36D + (c_custkey % 64) / 64D AS lat",
        "35D + (c_custkey % 96) / 64D AS lon",
    )


def geo_index(spark: SparkSession, sf_dir: str, **options: bool) -> GeoIndex:
    return GeoIndex.build(gazetteer(spark, sf_dir), CENTROIDS, **options)


def weights() -> dict[str, list[int]]:
    """Linear model B5: fixed integer weights per label."""
    return {x: [((i + 1) * (d + 1)) % 7 - 3 for d in range(64)] for i, x in enumerate(LABELS)}
