"""The overview report: many figures from one pass over the messages."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.operators import aggregates as agg
from reliefsignals.operators.filters import Filters
from reliefsignals.operators.measures import compact, measure
from reliefsignals.operators.messages import top_messages
from reliefsignals.schema import Dataset


@dataclass(frozen=True)
class Overview:
    """The parts of the report.

    All but the message list read ``shared``, a small table of sums.
    """

    summary: DataFrame
    label_counts: DataFrame
    prevalence: DataFrame
    temporal: DataFrame
    province_map: DataFrame
    top_messages: DataFrame
    hours: DataFrame
    default_hour: DataFrame
    source: DataFrame
    shared: DataFrame

    def long(self) -> DataFrame:
        """All parts as one table ``section, item, measure, value``."""

        def part(section: str, frame: DataFrame, item: str | None) -> DataFrame:
            named = frame.withColumn("_item", F.lit("") if item is None else F.col(item))
            values = [c for c, t in frame.dtypes if c != item and t in ("double", "bigint", "int")]
            numbers = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in values]
            if not numbers:
                numbers = [F.struct(F.lit("listed").alias("measure"), F.lit(1.0).alias("value"))]
            return named.select(
                F.lit(section).alias("section"), F.col("_item").alias("item"), F.inline(F.array(*numbers))
            )

        parts = [
            part("summary", self.summary, "top_label"),
            part("label_counts", self.label_counts, "label"),
            part("prevalence", self.prevalence, "label"),
            part("temporal", self.temporal, "date"),
            part("province_map", self.province_map, "province"),
            part("top_messages", self.top_messages, "id"),
            part("hours", self.hours, "hour"),
            part("default_hour", self.default_hour, "hour"),
            part("source", self.source, "fact"),
        ]
        return reduce(DataFrame.unionByName, parts)


def overview(
    dataset: Dataset,
    filters: Filters | None = None,
    centroids: agg.Centroids = fv.PROVINCE_CENTROIDS,
    folder: str | None = None,
) -> Overview:
    """Build the report.

    Messages are summed per day, hour and province, and every figure comes from those sums.
    With a ``folder`` in shared storage the sums are written there once and all parts read
    them; nothing stays in memory.  Without one each part that is read sums messages itself.
    The message list reads messages, with the filters pushed to the scan.
    """
    m = compact(measure(dataset, filters, whole=True), ["date_value", "hour", "province"])
    if folder is not None:
        m.frame.write.parquet(folder)
        m = replace(m, frame=m.frame.sparkSession.read.schema(m.frame.schema).parquet(folder))
    facts = agg.source_facts(dataset)
    spark = dataset.frame.sparkSession
    return Overview(
        summary=agg.summary(m),
        label_counts=agg.label_counts(m),
        prevalence=agg.prevalence(m),
        temporal=agg.temporal_daily(m),
        province_map=agg.province_map(m, centroids=centroids),
        top_messages=top_messages(dataset, filters),
        hours=agg.hours(m),
        default_hour=agg.default_hour(m),
        source=spark.createDataFrame(list(facts.items()), "fact string, value string"),
        shared=m.frame,
    )
