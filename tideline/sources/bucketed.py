"""Folders of Parquet files whose buckets Spark knows, so that joins and windows on the bucket column need no shuffle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tideline.sources.state import file_system, remove


def known_as(spark: SparkSession, path: str, columns: list[str], partition: str, key: str | None, buckets: int, order: list[str] | tuple = ()) -> str:
    """The name under which the session knows the folder; its partitions are looked up.

    columns: "name type", the partition column's too. Without buckets (0) rows stay in the files of the tasks that made them.
    """
    name = "tideline_" + hashlib.md5(path.encode()).hexdigest()[:20]
    if not spark.catalog.tableExists(name):
        by_order = f"SORTED BY ({', '.join(order)}) " if order else ""
        dealt = f"CLUSTERED BY ({key}) {by_order}INTO {buckets} BUCKETS " if buckets else ""
        spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}) USING parquet PARTITIONED BY ({partition}) {dealt}LOCATION '{path}'")
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")  # other sessions may have written some
    return name


def write_partition(name: str, path: str, rows: DataFrame, partition: str, value: int) -> None:
    """Write one partition of a table, which may be read from for it; what a writer that broke off left of it goes first."""
    spark, columns = rows.sparkSession, ", ".join(c for c in rows.columns if c != partition)
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({partition} = {value})")
    remove(spark, f"{path}/{partition}={value}")
    spark.sql(f"INSERT INTO TABLE {name} PARTITION ({partition} = {value}) ({columns}) SELECT {columns} FROM {{rows}}", rows=rows)


def write_all(name: str, rows: DataFrame, partition: str) -> None:
    """Fill an empty table; partitions by the rows' column."""
    columns = ", ".join([*(c for c in rows.columns if c != partition), partition])
    rows.sparkSession.sql(f"INSERT INTO TABLE {name} ({columns}) SELECT {columns} FROM {{rows}}", rows=rows)
