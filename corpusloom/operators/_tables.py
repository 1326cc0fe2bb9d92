"""Tables between the steps of an operator: Parquet below ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one below the warehouse where none is set, which a cluster may not do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table that is read again, so that lineage ends; ``by`` are columns of folders."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Tables:
    """Tables of one run, deleted at the end, also after an error; ``kept`` gives one that stays for the result to read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return stored(df, name, self.paths[-1])

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)
