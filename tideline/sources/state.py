"""The state of a stored table: numbered JSON files in a folder, each written once; the last whole one holds.

A change writes its data first and its state last, so what a crash leaves behind is never read, and doing it again is safe. Two
writers can't both write the same number: the second gets an error. Folders are reached through Spark's file systems only.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def bytes_under(spark: SparkSession, path: str) -> int:
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


class State:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _text(self, number: int) -> str:
        fs, at = file_system(self.spark, f"{self.path}/{number:09d}.json")
        stream = fs.open(at)
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> dict | None:
        """The last whole state; None before the first."""
        for number in reversed(self._numbers()):
            try:
                return json.loads(self._text(number))
            except ValueError:  # its writer died: never valid
                continue
        return None

    def write(self, value: dict) -> None:
        number = max(self._numbers(), default=-1) + 1
        fs, at = file_system(self.spark, f"{self.path}/{number:09d}.json")
        stream = fs.create(at, False)  # fails if another writer was first
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
