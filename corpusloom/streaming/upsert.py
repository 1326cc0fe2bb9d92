"""Latest row of each key from an at-least-once stream: keyed state before a table that takes every batch once.

The state holds the order (stamp, then tie columns) of each key's latest row, a table for each part of the keys, so that rows which change nothing are not written. The table merges what comes by the same order and
notes each batch by its number: a batch that is run again after a crash replaces its first try, and one that was finished is passed over. The result therefore does not
depend on the order of the files, on repeated rows, on crashes, or on the state being lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spine import keep_latest

#: Order of a null: before all others.
LEAST = -(2**63)
#: Parts that keys are dealt to, each with one state; types that pass pandas as texts.
PARTS, WHOLE = 256, ("tinyint", "smallint", "int", "bigint")


class UpsertTable:
    """Rows by key in ``buckets`` folders below ``path``; a batch rewrites the buckets that it touches, and readers see a batch as a whole or not at all.

    ``commits/N.json`` names, after batch N, the batch that wrote each bucket last. One stream writes a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, stamp: str, *tiebreak: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.stamp, self.tiebreak, self.buckets = spark, path.rstrip("/"), schema, key, stamp, tiebreak, buckets
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self._fs = self._folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def batches(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._folder) if f.getPath().getName().endswith(".json"))

    def commit_of(self, batch: int) -> dict:
        return json.loads(self.spark.read.text(self._path(f"{batch}.json").toString(), wholetext=True).first().value)

    def _commit(self, batch: int, note: dict) -> None:
        """A new name that appears whole: readers list only finished notes."""
        draft = self._path(f"_{batch}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{batch}.json")):
            raise RuntimeError(f"batch {batch} has been committed by another writer")

    def _folders(self, where: dict[str, int], buckets: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/data/batch={where[b]}/bucket={b}" for b in buckets if b in where]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table after its last finished batch."""
        done = self.batches()
        where = self.commit_of(done[-1])["buckets"] if done else {}
        return self._folders(where, where)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch; False if it had been merged before. Rows without a key are left out and counted."""
        done = self.batches()
        if done and done[-1] >= batch:
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        where = self.commit_of(done[-1])["buckets"] if done else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")
        rows.persist()
        try:
            late = F.count_if("late") if "late" in rows.columns else F.lit(0).cast("long")
            seen = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(self.key).isNull()).alias("keyless"), late.alias("late"), F.collect_set(F.when(F.col(self.key).isNotNull(), bucket)).alias("buckets")).first()
            changes = rows.where(F.col(self.key).isNotNull()).select(*columns)
            merged = keep_latest(self._folders(where, seen.buckets).unionByName(changes), self.key, self.stamp, *self.tiebreak)
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        finally:
            rows.unpersist()
        self._commit(batch, {"buckets": where | dict.fromkeys(seen.buckets, batch), "rows": seen.rows, "keyless": seen.keyless, "late": seen.late})
        return True

    def forget(self, keep: int = 2) -> None:
        """Delete the notes of all but the last ``keep`` batches and the folders that none of those needs."""
        done = self.batches()
        needed = {b for n in done[-keep:] for b in self.commit_of(n)["buckets"].values()}
        for n in done[:-keep]:
            self._fs.delete(self._path(f"{n}.json"), False)
        for n in set(done) - needed:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch={n}"), True)


def winners(rows: pd.DataFrame, key: str, orders: list[str]) -> pd.DataFrame:
    """The last row of each key by ``orders``; of equal ones the one that stands last."""
    return rows.sort_values(orders, kind="stable").drop_duplicates(key, keep="last")


def newer(columns: list[str], key: str, orders: list[str]):
    """Rows of a part's keys that are not older than the state's, marked late if their stamp is before the watermark; the state is an Arrow table of the part's keys and orders."""
    names = [key, *orders]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        rows = None
        for frame in frames:  # of what has come so far, only the latest rows are kept
            rows = frame if rows is None else pd.concat([rows, frame], ignore_index=True)
            rows = rows.merge(winners(rows, key, orders)[names], on=names)
        latest = winners(rows, key, orders)[names].assign(__new=True)
        if before is not None:
            latest = winners(pd.concat([before.assign(__new=False), latest], ignore_index=True), key, orders)
        table = pa.Table.from_pandas(latest[names], preserve_index=False).replace_schema_metadata()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        fresh = rows.merge(latest.loc[latest["__new"], names], on=names)
        yield fresh[columns].assign(late=fresh[orders[0]] < state.getCurrentWatermarkMs() * 1000)

    return run


def latest_changes(stream: DataFrame, key: str, stamp: str, *tiebreak: str, late: str = "2 hours", parts: int = PARTS) -> DataFrame:
    """The stream's rows that become their key's latest, with a column ``late``; of a batch's rows of one key the latest only.

    The keys are dealt to ``parts`` by a hash, which a checkpoint fixes, and a part's rows of a batch meet its state at once; the state has a small row for each key, for ever: a timeout would keep
    a run over what is there from ending. ``tiebreak`` columns are whole numbers. Null stamps and ties are the oldest. Late rows are marked, never dropped: a key's first row may come late.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    orders = [f"__o{i}" for i in range(1 + len(tiebreak))]
    at = F.col(stamp).cast("timestamp")
    # whole numbers and times pass pandas as texts and microseconds: it would make floats of those with a null beside them
    sent = {c: F.col(c).cast("string") if k in WHOLE else F.unix_micros(c).cast("string") if k == "timestamp" else F.col(c) for c, k in kinds.items()}
    back = {c: F.col(c).cast(k) if k in WHOLE else F.timestamp_micros(F.col(c).cast("long")) if k == "timestamp" else F.col(c) for c, k in kinds.items()}
    marked = stream.withColumns({"__at": at, "__part": F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(parts))), orders[0]: F.coalesce(F.unix_micros(at), F.lit(LEAST))} | {o: F.coalesce(F.col(c).cast("long"), F.lit(LEAST)) for o, c in zip(orders[1:], tiebreak, strict=True)})
    marked = marked.withWatermark("__at", late).select("__at", "__part", *orders, *[v.alias(c) for c, v in sent.items()])
    out = ", ".join(f"`{c}` {'string' if k in WHOLE or k == 'timestamp' else k}" for c, k in kinds.items()) + ", late boolean"
    changed = marked.groupBy("__part").applyInPandasWithState(newer(list(kinds), key, orders), out, "keys binary", "update", GroupStateTimeout.NoTimeout)
    return changed.select(*[v.alias(c) for c, v in back.items()], "late")


def upsert_files(table: UpsertTable, source: str, checkpoint: str, late: str = "2 hours", files_per_batch: int = 1, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run the table over the Parquet files of ``source`` that no earlier run has finished, then stop. ``before_commit`` is called with each batch's number first."""
    stream = table.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(rows: DataFrame, batch: int) -> None:
        if before_commit is not None:
            before_commit(batch)
        if not table.upsert(rows, batch):
            rows.write.format("noop").mode("overwrite").save()  # the batch must run for its state to be there for the next one

    query = latest_changes(stream, table.key, table.stamp, *table.tiebreak, late=late).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
