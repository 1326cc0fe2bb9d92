"""Exact inner-product search over vectors in descending length.

Vectors are stored by descending length. Queries go in blocks, each against all vectors, several blocks in one job. A block carries, for every query, a
lower bound of its k-th score, from the longest vectors. A task skips the slices whose longest vector
the Cauchy-Schwarz bound |q| |c| rules out, in whatever order it reads files; in the others, inner products of the leading dimensions
of an SVD rotation plus the product of the residual lengths rule out single pairs. What is left is scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, read_table, stored

#: Queries of a block, about; the longest vectors that give the first bounds; vectors that are scored at a time.
BLOCK, SEEDS, ROWS = 8192, 2048, 4096
#: Bytes of a block's queries, which are broadcast, and with them its most queries where vectors are long.
BLOCK_BYTES = 32 << 20
#: Blocks whose searches run in one job; so many broadcasts are held at a time.
WAVE = 8
#: Rows of a stored partition, about.
PART_ROWS = 100_000
#: Leading dimensions of the rotation, as a share; pairs that it must rule out to be worth it.
LEADING, WORTH = 0.25, 0.5


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered float64 rows: through float64 where that is exact, else in Python's integers."""
    bound = queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
    if bound < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    out = whole(queries) @ whole(vectors).T
    if max(abs(int(v)) for v in out.ravel()) >= 2**63:
        raise OverflowError("a score does not fit in 64 bits")
    return out.astype(np.int64)


class Best:
    """The k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # largest id that a score equal to the floor may have
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of queries ``which`` (rows) with the vectors ``ids`` (columns)."""
        floor = self.floor[which][:, None]
        ok = (scores > floor) | ((scores == floor) & (ids[None, :] <= self.last[which][:, None]))
        ok &= ids[None, :] != self.ids[which][:, None]
        for row in np.flatnonzero(ok.any(axis=1)).tolist():
            q, at = int(which[row]), np.flatnonzero(ok[row])
            s, i = np.append(self.rows[q][0], scores[row, at]), np.append(self.rows[q][1], ids[at])
            order = np.lexsort((i, -s))[: self.k]
            self.rows[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q], self.last[q] = s[order[-1]], i[order[-1]]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), d)


def search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, rotation, floor = shared.value
        d = queries.shape[1]
        lead = max(1, int(d * LEADING))
        length = np.sqrt((queries**2).sum(axis=1))
        turned = queries @ rotation[:, :lead]
        rest = np.sqrt(np.maximum(length**2 - (turned**2).sum(axis=1), 0))
        best, rotate = Best(ids, floor, k), True
        slack = 1 + 1e-9
        for batch in (b for whole in batches for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS))):
            vectors, their = matrix(batch.column(1), d), np.asarray(batch.column(0))
            lengths = np.sqrt((vectors**2).sum(axis=1))
            # a task may read several files in any order, so a slice is skipped by its own longest vector and nothing ends the task
            which = np.flatnonzero(length * lengths.max() * slack + 1 >= best.floor)
            if not len(which):
                continue
            columns = np.arange(len(their))
            if rotate:
                head = vectors @ rotation[:, :lead]
                left = np.sqrt(np.maximum(lengths**2 - (head**2).sum(axis=1), 0))
                open_ = turned[which] @ head.T + rest[which][:, None] * left + 1 + 1e-9 * length[which][:, None] * lengths >= best.floor[which][:, None]
                columns, rows = np.flatnonzero(open_.any(axis=0)), np.flatnonzero(open_.any(axis=1))
                which = which[rows]
                # later blocks of this task skip the rotation where it rules out too little
                rotate = len(columns) * len(rows) < WORTH * open_.size
            if len(which) and len(columns):
                best.add(which, their[columns], exact_scores(queries[which], vectors[columns]))
        out = [(q, i, s) for q, (scores, found) in enumerate(best.rows) for s, i in zip(scores.tolist(), found.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int32()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64())], names=["at", "vec_id", "score"])

    return run


def gram(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, d, length) with components floor(scale * x), of rows with an id and finite components only."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(F.coalesce(x, F.array().cast("array<double>")), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    out = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return out.select("vec_id", "v", F.size("v").alias("d"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c).alias("length"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the largest integer inner products with each query.

    Components count as floor(scale * x). Queries are the rows that ``is_query`` (an expression of vec_id) names; a query's
    candidates are all rows of other ids and of as many components; vectors without components score 0. Ties go to the smaller id; with fewer candidates
    all are returned. Rows without an id, without a vector, or with null or non-finite components take no part. Repeated rows
    are candidates each and queries each, in whatever order files are read. Other columns are not read; an empty table gives no rows. A score
    beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    results = []
    with Scratch(spark) as scratch:
        table = scratch.stored(whole_vectors(vectors, id_col, vec_col, scale), "vectors")
        for d, n in sorted((r[0], r[1]) for r in table.groupBy("d").count().collect()):
            own = table.where(F.col("d") == d)
            by_length = own.select("vec_id", "v", "length").repartitionByRange(max(1, -(-n // PART_ROWS)), F.col("length").desc(), "vec_id")
            by_length = scratch.stored(by_length.sortWithinPartitions(F.col("length").desc(), "vec_id"), "vectors-by-length")
            results += blocks_of(by_length, by_length.where(is_query).select("vec_id", "v"), d, k)
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def blocks_of(by_length: DataFrame, queries: DataFrame, d: int, k: int) -> list[DataFrame]:
    """Stored results (query_id, rank, vec_id, score) of all queries. WAVE blocks of queries, each with a broadcast of its own, run in one job."""
    spark = by_length.sparkSession
    sums = by_length.select("v").mapInArrow(gram(d), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()  # d * d rows
    rotation = np.linalg.svd(np.asarray(sums.column("v")).reshape(d, d))[0] if d else np.zeros((0, 0))
    seeds = by_length.orderBy(F.col("length").desc(), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow().combine_chunks()
    seed_ids = np.asarray(seeds.column("vec_id")).astype(np.int64)
    seed_rows = matrix(seeds.column("v").combine_chunks(), d) if d else np.zeros((len(seed_ids), 0))
    blocks = max(1, -(-queries.count() // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, d))))))
    results = []
    for wave in range(0, blocks, WAVE):
        found, shares = None, []
        for b in range(wave, min(wave + WAVE, blocks)):
            block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
            if not block.num_rows:
                continue
            ids = np.asarray(block.column("vec_id")).astype(np.int64)
            rows = matrix(block.column("v").combine_chunks(), d) if d else np.zeros((len(ids), 0))
            first = Best(ids, np.full(len(ids), np.iinfo(np.int64).min), k)
            for i in range(0, len(ids), 256):
                some = np.arange(i, min(i + 256, len(ids)))
                first.add(some, seed_ids, exact_scores(rows[some], seed_rows))
            shares.append(spark.sparkContext.broadcast((ids, rows, rotation, first.floor)))
            names = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids}))
            own = by_length.select("vec_id", "v").mapInArrow(search(shares[-1], k), "at int, vec_id long, score long").withColumn("block", F.lit(b)).join(F.broadcast(names), "at")
            found = own if found is None else found.unionByName(own)
        if found is not None:
            # a query that stands in several rows is searched for each of them
            order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), "vec_id")
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            results.append(stored(found.select("query_id", "rank", "vec_id", "score"), "top-k"))
        for share in shares:
            share.destroy()
    return results


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, CAST(len(q.v) + 1 AS BIGINT)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
