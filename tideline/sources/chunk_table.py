"""A stored chunk table: loads are merged when read.

A load writes only its own rows, as a delta dealt to buckets by a hash of the key. Compaction writes the latest rows as a base
that is partitioned for filters, dealt to the same buckets and sorted for row-group statistics. As base and deltas share their
buckets, a reader takes the latest of each key bucket by bucket, without a shuffle; filters reach the base's partitions and
row groups, because keys that came again since are left out of it by an anti-join before the deltas' rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.sources.bucketed import known_as, write_all, write_partition
from tideline.sources.state import State, bytes_under, remove


#: Rows of a file of a load, about: what a task sorts to write it.
FILE_ROWS = 65_536


class ChunkTable:
    """path: a folder that all executors reach. State: base (its number), loads (not yet in the base), done (every load so far)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.state = spark, path.rstrip("/"), State(spark, f"{path.rstrip('/')}/state")
        self.about = self.state.read()
        if self.about is None:
            raise FileNotFoundError(f"no chunk table in {path}")
        self.key, self.part, self.buckets = (self.about[n] for n in ("key", "part", "buckets"))
        self.columns, self._known = [c.split(" ")[0] for c in self.about["schema"]], {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, key: str = "chunk_id", part: str = "society", order: tuple[str, ...] = ("version_year", "chapter_section"), buckets: int = 16) -> ChunkTable:
        """An empty table of like's columns. buckets: so many that one bucket of the base fits a task."""
        schema = [f"{f.name} {f.dataType.simpleString()}" for f in like.schema.fields]
        State(spark, f"{path.rstrip('/')}/state").write({"key": key, "part": part, "order": list(order), "buckets": buckets, "schema": schema, "base": None, "loads": [], "done": []})
        return cls(spark, path)

    # ------------------------------------------------------------ tables

    def _deltas(self) -> str:
        if "delta" not in self._known:
            self._known["delta"] = known_as(self.spark, f"{self.path}/delta", [*self.about["schema"], "deleted boolean", "load_no bigint"], "load_no", self.key, self.buckets)
        return self._known["delta"]

    def _base(self, number: int) -> str:
        if number not in self._known:
            self._known[number] = known_as(self.spark, f"{self.path}/base{number}", self.about["schema"], self.part, self.key, self.buckets, self.about["order"])
        return self._known[number]

    def _drop(self, number: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._base(number)}")
        self._known.pop(number)
        remove(self.spark, f"{self.path}/base{number}")

    def _commit(self, **changes) -> None:
        about = self.about | changes
        self.state.write(about)
        self.about = about

    # ------------------------------------------------------------ writing

    def load(self, rows: DataFrame, number: int) -> None:
        """Insert or replace rows by key. A load of a number that is done does nothing; one that broke off is written anew.

        Of rows with one key in a load the greatest, by the columns in order, counts. Null keys are refused.
        """
        self._write(rows.select(*self.columns, F.lit(False).alias("deleted")), number)

    def delete_documents(self, doomed: DataFrame, number: int, by: str = "doc_id") -> DataFrame:
        """Remove all rows of the documents (by); returns (by, n_deleted), read from what was written."""
        keys = self.rows().select(self.key, by).join(doomed.select(by).distinct(), by, "left_semi").select(self.key)
        # Dealt as the table is, so that whole rows stay where they are and aren't sorted.
        gone = self.rows().join(keys.repartition(self.buckets, self.key).hint("shuffle_hash"), self.key, "left_semi")
        self._write(gone.select(*self.columns, F.lit(True).alias("deleted")), number)
        return self.deleted(number, by)

    def deleted(self, number: int, by: str = "doc_id") -> DataFrame:
        """(by, n_deleted) of what a load removed, until it is vacuumed."""
        return self.spark.table(self._deltas()).filter((F.col("load_no") == number) & F.col("deleted")).groupBy(by).agg(F.count("*").alias("n_deleted"))

    def _write(self, rows: DataFrame, number: int) -> None:
        if number in self.about["done"]:
            return
        if self.about["done"] and number < max(self.about["done"]):
            raise ValueError(f"load {number} comes after load {max(self.about['done'])}")
        rows = rows.filter(F.col(self.key).isNotNull())
        keys = rows.groupBy(self.key).agg(F.count("*").alias("n"))
        n, most = keys.agg(F.sum("n"), F.max("n")).first()
        # A multiple of the buckets, so that a task writes files of one bucket.
        one = rows.repartition(self.buckets * max(1, -(-(n or 0) // (self.buckets * FILE_ROWS))), self.key)
        if (most or 0) > 1:
            first = Window.partitionBy(self.key).orderBy(*(F.desc(c) for c in self.columns if c != self.key))
            one = one.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
        write_partition(self._deltas(), f"{self.path}/delta", one, "load_no", number)
        self._commit(loads=[*self.about["loads"], number], done=[*self.about["done"], number])

    def compact(self) -> None:
        """Write the latest rows as a new base, bucket by bucket; the deltas so far are then no longer read."""
        number = (self.about["base"] or 0) + 1
        self._drop(number)  # what a compaction that broke off left
        write_all(self._base(number), self.rows(), self.part)
        self._commit(base=number, loads=[])

    def vacuum(self) -> None:
        """Remove files that the state no longer names: readers that began before may fail."""
        for n in range(1, self.about["base"] or 0):
            self._drop(n)
        for n in [n for n in self.about["done"] if n not in self.about["loads"]]:
            self.spark.sql(f"ALTER TABLE {self._deltas()} DROP IF EXISTS PARTITION (load_no = {n})")
            remove(self.spark, f"{self.path}/delta/load_no={n}")

    # ------------------------------------------------------------ reading

    def rows(self, where: Column | None = None) -> DataFrame:
        """The latest row of every key that isn't deleted, of those that satisfy ``where`` (over the table's columns)."""
        fits = F.lit(True) if where is None else where
        parts = []
        deltas = latest = None
        if self.about["loads"]:
            deltas = self.spark.table(self._deltas()).filter(F.col("load_no").isin(self.about["loads"]))
            latest = deltas
            # Hashed sides of keys alone: whole rows are neither moved nor sorted. A load has a key once.
            newest = deltas.groupBy(F.col(self.key).alias("__key")).agg(F.max("load_no").alias("__load")).hint("shuffle_hash")
            if len(self.about["loads"]) > 1:
                latest = deltas.join(newest, (F.col(self.key) == F.col("__key")) & (F.col("load_no") >= F.col("__load")), "left_semi")
            parts.append(latest.filter(~F.col("deleted")).filter(fits).select(*self.columns))
        if self.about["base"]:
            base = self.spark.table(self._base(self.about["base"])).filter(fits).select(*self.columns)
            parts.append(base if deltas is None else base.join(newest, F.col(self.key) == F.col("__key"), "left_anti").select(*self.columns))
        if not parts:
            return self.spark.createDataFrame([], ", ".join(self.about["schema"]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def written_bytes(self, number: int) -> int:
        return bytes_under(self.spark, f"{self.path}/delta/load_no={number}")
