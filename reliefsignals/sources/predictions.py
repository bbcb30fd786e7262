"""Prediction tables: read CSV or Parquet, publish as partitioned Parquet."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from reliefsignals.fixed_values import NA_CELLS
from reliefsignals.operators.measures import summed
from reliefsignals.operators.prepare import prepare
from reliefsignals.schema import Dataset, Metadata, Published
from reliefsignals.sources.search import SIGNATURE, signatures
from reliefsignals.sources.versions import Store


def read_cells(
    spark: SparkSession, path: str, schema: StructType | None = None, *, multi_line: bool = False
) -> DataFrame:
    """Read a CSV with header; every cell is text and missing-value marks are null.

    Files are split, so a record must be one line.  Where quoted cells hold line breaks,
    ``multi_line=True`` reads each file in one task; the cells are then dealt out again
    before anything else is done with them.  A ``schema`` of strings spares the job that
    reads the header.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    cells = reader.csv(path)
    if multi_line:
        cells = cells.hint("rebalance")
    return cells.select(
        *[F.when(~F.col(f"`{c}`").isin(*NA_CELLS), F.col(f"`{c}`")).alias(c) for c in cells.columns]
    )


def load_predictions(
    spark: SparkSession,
    path: str,
    metadata: Metadata | None = None,
    *,
    schema: StructType | None = None,
    multi_line: bool = False,
    day_first: bool = False,
    info_rule: bool = True,
    name: str | None = None,
) -> Dataset:
    """Read raw predictions (CSV, or Parquet when the path ends so) and prepare them."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = read_cells(spark, path, schema, multi_line=multi_line)
    return Dataset.of(prepare(raw, metadata, info_rule=info_rule, day_first=day_first), metadata, name or path)


#: The partition column beside ``date``: the local wall clock's day.
DAY = "local_day"


MESSAGES, SUMS, SIGNATURES = "messages", "sums", "signatures"
TABLES = (MESSAGES, SUMS, SIGNATURES)


def _days_of(frame: DataFrame) -> list[str]:
    """The local days of a table as texts; \"\" stands for messages without one."""
    rows = frame.select(F.coalesce(F.col(DAY).cast("string"), F.lit("")).alias("day")).distinct().collect()
    return [r.day for r in rows]


def _stage(store: Store, version: str, dataset: Dataset, search: bool) -> list[str]:
    """Write a table, its sums and its signatures under a version no reader knows of yet."""
    frame = dataset.frame
    day = F.col("created_at_local").cast("date") if "created_at_local" in frame.columns else F.lit(None).cast("date")
    order = [c for c in ("date", DAY, "created_at_local") if c in frame.columns or c == DAY]
    balanced = frame.drop(DAY).withColumn(DAY, day).hint("rebalance", "date", DAY).sortWithinPartitions(*order)
    balanced.write.partitionBy("date", DAY).parquet(store.folder(MESSAGES, version))
    stored = StructType([*frame.drop(DAY).schema.fields, StructField(DAY, DateType())])
    folder = store.folder(MESSAGES, version)
    staged = frame.sparkSession.read.schema(stored).option("basePath", folder).parquet(folder)
    cells = summed(replace(dataset, frame=_with_dates(staged)))
    cells.withColumn(DAY, F.col("hour").cast("date")).repartition(F.col(DAY)).write.partitionBy(DAY).parquet(store.folder(SUMS, version))
    if search:
        signatures(staged).write.partitionBy(DAY).parquet(store.folder(SIGNATURES, version))
    return _days_of(staged)


def _with_dates(frame: DataFrame) -> DataFrame:
    """The folder of an empty date reads back as null."""
    return frame.withColumn("date", F.coalesce(F.col("date"), F.lit("")))


def publish_predictions(dataset: Dataset, path: str, *, overwrite: bool = False, search: bool = False) -> None:
    """Write a prepared table as Parquet by ``date`` and local day, and what is known of it beside.

    ``date`` may be a given text; the day is derived from the time stamp and serves time
    ranges.  For most tables the two agree and there is one folder per day.  The rebalance
    hint lets AQE split a day that holds much of the table over many tasks and merge small
    ones.  Rows are sorted inside each file, which lets a time range skip row groups.

    Beside the messages lie their sums per hour and place, from which counts are answered, and
    with ``search`` signatures of their texts, which let a search skip files and times
    (``sources.search``).  Metadata, kind, name and schema are in the manifest.  Everything is
    staged under a new version and becomes visible with the manifest, written last: readers
    meanwhile, and after a crash, see the version before (``sources.versions``).
    """
    store = Store(dataset.frame.sparkSession, path)
    before = store.current()
    if before is not None and not overwrite:
        raise AnalysisException(f"{path} is published already; overwrite=True puts a new version in its place")
    version = store.new_version()
    days = _stage(store, version, dataset, search)
    facts = {
        "metadata": dict(dataset.metadata),
        "kind": dataset.kind,
        "name": dataset.name,
        "schema": dataset.frame.drop(DAY).schema.jsonValue(),
        "search": search,
    }
    store.commit({d: version for d in days}, facts, before)


def replace_days(dataset: Dataset, path: str) -> None:
    """Publish the days of a dataset in the place of the same days of a published table.

    Messages, sums and signatures of these days are written under a new version; all other days
    stay where they are, unread.  Days change all at once, or not at all.
    """
    store = Store(dataset.frame.sparkSession, path)
    before = store.current()
    if before is None:
        raise AnalysisException(f"{path} is not published")
    names = [f["name"] for f in before.facts["schema"]["fields"]]
    given = dataset.frame.drop(DAY)
    if sorted(given.columns) != sorted(names):
        raise AnalysisException(f"{path} has the columns {names}, not {given.columns}")
    columns = StructType.fromJson(before.facts["schema"])
    same = given.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns.fields])
    version = store.new_version()
    days = _stage(store, version, Dataset.of(same, before.facts["metadata"], before.facts["name"], before.facts["kind"]), before.facts["search"])
    store.commit({**before.days, **{d: version for d in days}}, before.facts, before)


def prune_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete what no reader of the current version needs (see ``Store.prune``)."""
    return Store(spark, path).prune(TABLES)


def read_published(spark: SparkSession, path: str) -> Published:
    """Open a published table: labels, kind and declared figures come with it.

    The schema is stated, so no text is taken for a number.  ``date`` filters prune its
    folders, and so does ``during`` by the local day.  Counts that the sums can answer are read
    from them (``Published.answers``).
    """
    store = Store(spark, path)
    now = store.current()
    if now is None:
        raise AnalysisException(f"{path} is not published")
    facts = now.facts
    columns = StructType.fromJson(facts["schema"])
    day = StructField(DAY, DateType())

    def messages(files: list[str] | None = None) -> DataFrame:
        frame = store.read(now, MESSAGES, StructType([*columns.fields, day]), DAY, files)
        return _with_dates(frame).select(*columns.names, DAY)

    frame = messages()
    dataset = Dataset.of(frame, facts["metadata"], facts["name"], facts["kind"])
    sums = store.read(now, SUMS, StructType([*summed(dataset).schema.fields, day]), DAY).drop(DAY)
    marks = store.read(now, SIGNATURES, StructType([*SIGNATURE.fields, day]), DAY) if facts["search"] else None
    return Published(frame, dataset.schema, dataset.metadata, dataset.name, dataset.kind, whole=frame, sums=sums, signatures=marks, of_files=messages)
