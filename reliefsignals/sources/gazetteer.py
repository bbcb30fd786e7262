"""Place coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.functions.numbers import number_or_null
from reliefsignals.functions.text import fix_mojibake, normalize_location, strip
from reliefsignals.sources.predictions import read_cells

GAZETTEER_COLUMNS = ("province", "district", "neighborhood_clean", "lat", "lon")


def clean_gazetteer(raw: DataFrame) -> DataFrame:
    """Normalise names, add absent columns as '', drop rows without numeric coordinates."""
    have = {c: F.col(c) if c in raw.columns else F.lit("") for c in GAZETTEER_COLUMNS}
    return raw.select(
        normalize_location(have["province"]).alias("province"),
        normalize_location(have["district"]).alias("district"),
        F.lower(strip(fix_mojibake(have["neighborhood_clean"]))).alias("neighborhood_clean"),
        number_or_null(have["lat"]).alias("lat"),
        number_or_null(have["lon"]).alias("lon"),
    ).dropna(subset=["lat", "lon"])


def load_gazetteer(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Read a gazetteer CSV (or Parquet when the path ends so)."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = read_cells(spark, path, multi_line=multi_line)
    return clean_gazetteer(raw)
