"""Reading and writing lake datasets."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.sources import schemas


class LakePaths:
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def at(self, zone: str, dataset: str) -> str:
        """Zone: bronze, silver, gold or warehouse."""
        return f"{self.root}/{zone}/{dataset}"


def path_list(paths: str | list[str]) -> list[str]:
    """A list, a JSON list, a comma-separated list or one path."""
    if isinstance(paths, list):
        return paths
    text = paths.strip()
    return json.loads(text) if text.startswith("[") else [p.strip() for p in text.split(",") if p.strip()]


def read_json(spark: SparkSession, paths: str | list[str], schema: str = schemas.WEB_LOG, corrupt: str | None = None) -> DataFrame:
    """corrupt: a column for the lines that aren't JSON; without it they are rows of nulls."""
    reader = spark.read.schema(f"{schema}, {corrupt} string").option("columnNameOfCorruptRecord", corrupt) if corrupt else spark.read.schema(schema)
    return reader.json(path_list(paths))


def read_csv(spark: SparkSession, dataset: str, folder: str | list[str]) -> DataFrame:
    """All files of a dataset in one scan, picked by name; malformed rows keep what parses. Quotes are doubled within quotes."""
    pattern, schema = schemas.CSV_DATASETS[dataset]
    reader = spark.read.schema(schema + ", _corrupt string").option("header", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("pathGlobFilter", pattern).csv(path_list(folder))


def with_ingestion(df: DataFrame, source: str, batch_id: str, load_date: date) -> DataFrame:
    return df.withColumns({
        "data_source": F.lit(source), "batch_id": F.lit(batch_id), "ingestion_timestamp": F.current_timestamp(), "source_file": F.col("_metadata.file_name"),
        "year": F.lit(f"{load_date:%Y}"), "month": F.lit(f"{load_date:%m}"), "day": F.lit(f"{load_date:%d}"),
    })


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", fmt: str = "parquet", **options: str) -> None:
    """Overwriting replaces only the partitions that df has."""
    writer = df.write.mode(mode).format(fmt).options(**({"partitionOverwriteMode": "dynamic"} if partition_by else {}), **options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_sorted(df: DataFrame, path: str, order: list[str], partition_by: list[str] | None = None, mode: str = "overwrite", files: int | None = None) -> None:
    """Parquet in global order: files, read by name, hold the rows as orderBy(order) has them (within each partition of the table, if it
    has any), and no task sorts more than its range. files: how many ranges at most, as many as shuffles have partitions by default."""
    keys = [*(partition_by or []), *order]
    ranges = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys), path, partition_by, mode)


class BadLoad(ValueError):
    """Too many rows of a load are malformed."""


def quarantined(df: DataFrame, dataset: str, load_id: str, path: str, most: float = 0.05, corrupt: str = "_corrupt") -> DataFrame:
    """The well-formed rows of df, which read_csv or read_json made. The others go to a table under path, by dataset and load_id, each as
    it stands in its file, with the file's name and what of it could be read; a rerun of the load replaces them. If they are more than
    `most` of all rows, BadLoad is raised, with the rows still in quarantine. Counts and quarantine come from one scan."""
    seen = Observation()
    parsed = [c for c in df.columns if c != corrupt]
    rows = df.select("*", F.col("_metadata.file_name").alias("_file")).observe(seen, F.count("*").alias("rows"), F.count(corrupt).alias("bad"))
    bad = rows.filter(F.col(corrupt).isNotNull()).select(F.lit(dataset).alias("dataset"), F.lit(load_id).alias("load_id"), F.col("_file").alias("source_file"), F.col(corrupt).alias("record"), F.to_json(F.struct(*parsed)).alias("parsed"))
    write(bad, path, ["dataset", "load_id"])
    found = seen.get
    if found["bad"] > most * found["rows"]:
        raise BadLoad(f"{dataset}, load {load_id}: {found['bad']} of {found['rows']} rows are malformed")
    return df.filter(F.col(corrupt).isNull()).drop(corrupt)


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first path that exists, without counting its rows."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            continue
    return None


def read_day(df: DataFrame, column: str, day: date) -> DataFrame:
    return df.filter(F.to_date(column) == F.lit(day)) if column in df.columns else df


def read_range(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    return df.filter((F.col(column) >= F.lit(first)) & (F.col(column) < F.date_add(F.lit(last), 1)))


def read_partition(df: DataFrame, **values: object) -> DataFrame:
    """Rows of some partitions, read from the base path so that the partition columns stay."""
    for k, v in values.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def to_warehouse(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").format(fmt).options(**options).saveAsTable(name)


def publish(df: DataFrame, fmt: str = "kafka", key: str = "event_id", **options: str) -> None:
    """Key and JSON value of each row to a topic (or, in tests, to files)."""
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    out.write.format(fmt).options(**options).mode("append").save()
