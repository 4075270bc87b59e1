"""Shared helpers: tables, written stage tables in the shared folder, words, scoped expressions."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.arrays import let  # noqa: F401  for the operators
from claimlens.session import checkpoint_dir, ship_package

#: The characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


class Stages:
    """Stage tables of one operator call, written to the shared folder.

    A written table is a lineage cut that survives lost executors, is computed
    once, and fixes what a recompute could change (row numbers, sampled range
    bounds). ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark, self.paths, self.tables = spark, {}, {}

    def write(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        path = shared(self.spark, name)
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        self.release()
        return self.read(name)

    def release(self) -> None:
        """Let Spark delete the shuffle files of what has just been written: it does when the
        driver collects its garbage, which a small driver seldom does by itself."""
        gc.collect()
        self.spark._jvm.System.gc()

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """``df`` written as a table bucketed and sorted by ``key``: joins on it don't move it again."""
        path = shared(self.spark, name)
        table_name = "llm_" + uuid.uuid4().hex
        df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table_name)
        self.drop(name)
        self.paths[name], self.tables[name] = path, table_name
        return self.spark.table(table_name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def whole(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
