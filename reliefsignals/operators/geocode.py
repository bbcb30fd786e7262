"""Coordinates for aggregated places, with fallback to wider places."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions.text import strip
from reliefsignals.operators.aggregates import Centroids, centroid

LEVELS = {
    "province": ("province",),
    "district": ("province", "district"),
    "neighborhood": ("province", "district", "neighborhood"),
}

# Gazetteers of at most this size are broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Column of a stored gazetteer that tells the copies of a row apart.
SALT = "_salt"


def gazetteer_neighborhoods(gazetteer: DataFrame) -> DataFrame:
    """Distinct neighbourhood coordinates; one neighbourhood may have several."""
    return gazetteer.select("province", "district", "neighborhood_clean", "lat", "lon").distinct()


def gazetteer_districts(gazetteer: DataFrame) -> DataFrame:
    """Mean coordinate of each district's gazetteer rows."""
    return gazetteer.groupBy("province", "district").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def gazetteer_provinces(gazetteer: DataFrame) -> DataFrame:
    """Mean coordinate of each province's gazetteer rows."""
    return gazetteer.groupBy("province").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


@dataclass(frozen=True)
class GeoIndex:
    """A gazetteer and the centroids used where it has no answer.

    ``build`` makes one.  ``small`` says that it measured the gazetteer and found it within
    the broadcast bound; the derived tables are no larger.  If it is false the joins carry no hint: Spark picks
    the strategy from the sizes it measures while running, and splits skewed provinces.
    """

    gazetteer: DataFrame
    small: bool = field(default=False, init=False)
    centroids: Centroids = field(default_factory=lambda: dict(fv.PROVINCE_CENTROIDS))
    dedupe: bool = False

    @classmethod
    def build(
        cls,
        gazetteer: DataFrame,
        centroids: Centroids | None = None,
        *,
        dedupe: bool = False,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> GeoIndex:
        """Measure the gazetteer (one aggregation) and set up the index."""
        texts = sum((F.octet_length(c) for c in ("province", "district", "neighborhood_clean")), F.lit(0))
        # Beside its texts a row takes two coordinates and the row's own overhead.
        size = gazetteer.agg(F.sum(F.coalesce(texts, F.lit(0)) + F.lit(64)).alias("bytes")).first()["bytes"] or 0
        small = size <= broadcast_bytes
        index = cls(gazetteer, dict(fv.PROVINCE_CENTROIDS if centroids is None else centroids), dedupe)
        object.__setattr__(index, "small", small)
        return index

    def _side(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table

    def neighborhoods(self) -> DataFrame:
        """Neighbourhood coordinates as ``lat_n, lon_n`` and the number of each copy.

        By default a neighbourhood with several coordinates yields several points;
        ``dedupe`` averages them.
        """
        keys = ["province", "district", "neighborhood_clean"]
        # Rows without a neighbourhood serve the wider means only; no place can match them.
        table = gazetteer_neighborhoods(self.gazetteer.where("neighborhood_clean != ''"))
        if self.dedupe:
            table = table.groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        copies = Window.partitionBy(*keys).orderBy("lat", "lon")
        table = table.withColumn("copy", F.lit(1) if self.dedupe else F.row_number().over(copies))
        return self._side(table.select(*keys, F.col("lat").alias("lat_n"), F.col("lon").alias("lon_n"), "copy"))

    def districts(self) -> DataFrame:
        table = gazetteer_districts(self.gazetteer)
        return self._side(table.withColumnsRenamed({"lat": "lat_d", "lon": "lon_d"}))

    def provinces(self) -> DataFrame:
        table = gazetteer_provinces(self.gazetteer)
        return self._side(table.withColumnsRenamed({"lat": "lat_p", "lon": "lon_p"}))


@dataclass(frozen=True)
class StoredGeoIndex(GeoIndex):
    """A gazetteer beyond the broadcast bound, stored in buckets of its join keys by ``store_index``.

    Joins read the buckets as they lie: only places are shuffled. Many hours and neighbourhoods of
    one district or province need the same row, so these rows are stored once per salt and
    their places are dealt over the salts.
    """

    tables: Mapping[str, str] = field(default_factory=dict)
    salts: int = 1

    def neighborhoods(self) -> DataFrame:
        return self._table("neighborhoods")

    def districts(self) -> DataFrame:
        return self._table("districts")

    def provinces(self) -> DataFrame:
        return self._table("provinces")

    def _table(self, name: str) -> DataFrame:
        return self.gazetteer.sparkSession.table(self.tables[name])


def store_index(index: GeoIndex, folder: str, name: str, *, buckets: int = 0, salts: int = 16) -> StoredGeoIndex:
    """Write the three tables of an index as bucketed tables ``<name>_<level>`` below a shared folder.

    There are at least as many buckets as shuffle partitions: with fewer, Spark would shuffle
    both sides to use all its partitions.
    """
    spark = index.gazetteer.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(SALT)
    wide = {"districts": ("province", "district"), "provinces": ("province",)}
    plain = GeoIndex(index.gazetteer, index.centroids, index.dedupe)
    frames = {"neighborhoods": (plain.neighborhoods(), ["province", "district", "neighborhood_clean"])}
    frames |= {k: (getattr(plain, k)().select("*", salt), [*keys, SALT]) for k, keys in wide.items()}
    tables = {}
    for level, (frame, keys) in frames.items():
        tables[level] = f"{name}_{level}"
        # One task writes one bucket, so a bucket is one file.
        dealt = frame.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        dealt.option("path", f"{folder.rstrip('/')}/{level}").saveAsTable(tables[level])
    return StoredGeoIndex(index.gazetteer, index.centroids, index.dedupe, tables, salts)


def geocode(places: DataFrame, level: str, index: GeoIndex) -> DataFrame:
    """Add ``lat, lon, level_used, placeable, copy`` to rows of one place each.

    Coordinates come from the neighbourhood, else the district, else the province, each
    axis by itself; where one is still missing the province centroid gives both.  At
    neighbourhood level a row without a neighbourhood is not ``placeable`` and gets no
    coordinate.  ``copy`` is 1 for the first (mostly only) point of a place.
    """
    df, salt, steps = places, [], []
    if isinstance(index, StoredGeoIndex):
        salt = [SALT]
        df = df.withColumn(SALT, F.pmod(F.xxhash64(*places.columns), F.lit(index.salts)).cast("int"))
    if level == "neighborhood":
        df = df.withColumn("neighborhood_clean", F.lower(strip(F.coalesce("neighborhood", F.lit("")))))
        df = df.join(index.neighborhoods(), ["province", "district", "neighborhood_clean"], "left")
        steps.append("n")
    if level in ("neighborhood", "district"):
        df = df.join(index.districts(), ["province", "district", *salt], "left")
        steps.append("d")
    df = df.join(index.provinces(), ["province", *salt], "left")
    steps.append("p")

    lat = F.coalesce(*[F.col(f"lat_{s}") for s in steps])
    lon = F.coalesce(*[F.col(f"lon_{s}") for s in steps])
    lacking = lat.isNull() | lon.isNull()
    center = [centroid(F.col("province"), index.centroids, axis) for axis in (0, 1)]
    placeable = F.col("neighborhood_clean") != "" if level == "neighborhood" else F.lit(True)

    def point(value: Column, fallback: Column) -> Column:
        return F.when(placeable, F.when(lacking & fallback.isNotNull(), fallback).otherwise(value))

    names = {"n": "neighborhood", "d": "district", "p": "province"}
    used = F.when(~placeable, F.lit("none"))
    used = used.when(lacking, F.when(center[0].isNotNull(), F.lit("centroid")).otherwise(F.lit("none")))
    for s in steps:
        used = used.when(F.col(f"lat_{s}").isNotNull(), F.lit(names[s]))
    return df.select(
        *places.columns,
        point(lat, center[0]).alias("lat"),
        point(lon, center[1]).alias("lon"),
        used.otherwise(F.lit("none")).alias("level_used"),
        placeable.alias("placeable"),
        (F.coalesce("copy", F.lit(1)) if level == "neighborhood" else F.lit(1)).alias("copy"),
    )
