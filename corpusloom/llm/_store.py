"""Shared-folder tables: lineage is cut by writing Parquet below ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one below the warehouse only where none is configured (tests), an error on a cluster."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder. ``drop`` deletes them, once what the result reads has been written elsewhere.

    As a context it drops them at the end, also after an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()

    def stored(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return stored(df, name, partition_by, path)

    def bucketed(self, df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
        """``df`` in ``n`` buckets that are sorted by the keys, so that joins on them neither shuffle nor sort it."""
        path, table = new_path(self.spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.paths.append(path)
        self.names.append(table)
        df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            delete(self.spark, path)
        self.names, self.paths = [], []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, wherever the shared folder lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def set_for(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (``__`` stands for a dot) for plans that run inside."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that do not clash with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
