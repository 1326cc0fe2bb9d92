"""Joins and duplicates of dense vectors by cosine: a threshold join with projection bounds, and semantic duplicates inside k-means cells.

Vectors that are null, empty, of another length than the first one, zero, or that hold a null or a number that is not finite take part in nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import new_path, stored

#: Queries that meet 512 rows at once, so that a task's products stay at 16 MB however many queries there are.
TILE = 2048
#: Bytes of query vectors in a broadcast, rows of the bounded sample that the rotation is taken from, and the share of the sample's squares that the first step holds.
QUERY_BYTES, ROTATED, HELD = 32 << 20, 2048, 0.6
#: Rows that make a cell on average, bytes of all centres, rounds of k-means, and cells that a row is compared in; bytes of the vectors of a block.
CELL, CENTRE_BYTES, ROUNDS, PROBES, BLOCK_BYTES = 8192, 64 << 20, 6, 2, 8 << 20
#: Cells that are CROWDED times as large as the mean and hold more than one SHARE-th of all rows have their PIVOTS smallest ids sent to all tasks: at most SHARE cells.
CROWDED, SHARE, PIVOTS = 4, 512, 32


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors, one a row."""
    n = len(column)
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1 if n else 0)
    # the largest component is taken out first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def length_of(*frames: DataFrame) -> int:
    """The length of the first frame's first vector by id; 0 without rows."""
    for df in frames:
        row = df.agg(F.min_by(F.size("v"), "id").alias("n")).first()
        if row.n:
            return row.n
    return 0


def rotation(df: DataFrame, sample: int) -> tuple[np.ndarray, int]:
    """An orthogonal basis in which a bounded sample's squares lie in few components, and the number of components that hold HELD of them.

    The bound holds for any basis; the sample only decides how much is skipped.
    """
    rows = df.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = matrix(rows.column(0).combine_chunks())
    _, s, basis = np.linalg.svd(x, full_matrices=True)
    squares = np.append(s * s, np.zeros(basis.shape[0] - len(s)))
    return basis.T, 1 + int(np.searchsorted(np.cumsum(squares) / squares.sum(), HELD))


def similarity_join(queries: DataFrame, pool: DataFrame, threshold: float, key: str, vector: str, query_key: str | None = None, query_vector: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, candidate, score): all pairs of different ids whose cosine, rounded to 6 places, is at least ``threshold`` (above 0).

    The queries are a stated set that meets all rows in blocks: each block of at most ``query_bytes`` is broadcast to one pass of the pool. Of each pair the inner product over
    the first components of a rotated basis is taken, and the lengths of what is left bound the rest (Cauchy-Schwarz); only pairs that can still reach the
    threshold are computed in full. Rows of one id are compared each; a pair is given for each of them.
    """
    if threshold <= 0:
        raise ValueError("the threshold is above 0")
    spark = pool.sparkSession
    asked, rows = usable(queries, query_key or key, query_vector or vector), usable(pool, key, vector)
    size = length_of(asked, rows)
    asked, rows = asked.where(F.size("v") == size), rows.where(F.size("v") == size)
    count = asked.count()
    schema = "query long, candidate long, score double"
    if not count or not size:
        return spark.createDataFrame([], schema)
    basis, held = rotation(asked, ROTATED)
    waves = -(-count * 8 * (size + 2) // query_bytes)
    at, path = F.pmod(F.xxhash64("id", "v"), F.lit(waves)), new_path(spark, "pairs")
    for wave in range(waves):
        part = asked.where(at == wave).toArrow()
        if part.num_rows:
            own = matrix(part.column(1).combine_chunks()) @ basis
            shared = spark.sparkContext.broadcast((np.asarray(part.column(0)), own, np.sqrt((own[:, held:] ** 2).sum(axis=1)), basis))
            rows.mapInArrow(reaching(shared, held, threshold), schema).write.mode("append").parquet(path)
            shared.destroy()
    return spark.read.schema(schema).parquet(path)


def reaching(shared, held: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, rest, basis = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                theirs = np.asarray(part.column(0))
                x = matrix(part.column(1)) @ basis
                left = np.sqrt((x[:, held:] ** 2).sum(axis=1))
                for j in range(0, len(own), TILE):
                    most = own[j : j + TILE, :held] @ x[:, :held].T
                    most += rest[j : j + TILE, None] * left[None]
                    q, c = np.nonzero(most >= threshold - 1e-5)
                    for k in range(0, len(q), 1 << 14):
                        qs, cs = j + q[k : k + (1 << 14)], c[k : k + (1 << 14)]
                        score = np.round((own[qs] * x[cs]).sum(axis=1), 6)
                        ok = (score >= threshold) & (ids[qs] != theirs[cs])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[qs][ok]), pa.array(theirs[cs][ok]), pa.array(score[ok])], names=["query", "candidate", "score"])

    return run


def contamination(pool: DataFrame, queries: DataFrame, threshold: float, key: str, vector: str) -> DataFrame:
    """(id, n_items, best_item, best_score, contaminated) of every row of the pool with an id: the test items above the threshold, the nearest one (ties: the smaller id)."""
    pairs = similarity_join(queries, pool, threshold, key, vector)
    best = F.max_by(F.struct("query", "score"), F.struct("score", -F.col("query")))
    hits = pairs.groupBy(F.col("candidate").alias(key)).agg(F.count_distinct("query").alias("n"), best.alias("b"))
    n = F.coalesce("n", F.lit(0))
    return pool.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key)).join(hits, key, "left").select(key, n.alias("n_items"), F.col("b.query").alias("best_item"), F.col("b.score").alias("best_score"), (n > 0).alias("contaminated"))


# --- semantic duplicates ---


def partial_sums(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        n, total = np.zeros(len(centres), dtype=np.int64), np.zeros_like(centres)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x = matrix(batch.column(1).slice(i, 1024))
                own = (x @ centres.T).argmax(axis=1)
                n += np.bincount(own, minlength=len(centres))
                np.add.at(total, own, x)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n[k]), pa.array(list(total[k]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return run


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one cell's partial sums; the rows of a cell are all here."""
    sums: dict[int, list] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            cell, n, total = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.asarray(batch.column(2)[i].values)
            was = sums.get(cell)
            sums[cell] = [n, total] if was is None else [was[0] + n, was[1] + total]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.list_(pa.float64()))], names=["cell", "n", "total"])


def spherical_k_means(rows: DataFrame, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``(id, v)`` rows. Each task adds up its rows by nearest centre, the sums of a centre meet in one task, and the driver gets k rows a round."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("id"), "id").limit(k).select("v").toArrow()
    centres = np.unique(matrix(first.column(0).combine_chunks()), axis=0)
    schema = "cell long, n long, total array<double>"
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        parts = rows.mapInArrow(partial_sums(shared), schema)
        sums = parts.repartition(min(len(centres), 64), "cell").mapInArrow(added, schema).toArrow()
        shared.destroy()
        moved = centres.copy()
        for cell, total in zip(sums.column("cell").to_pylist(), sums.column("total").to_pylist(), strict=True):
            length = np.linalg.norm(total)
            if length > 0:
                moved[cell] = np.asarray(total) / length
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def lots(ids: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A block for each row, by its id; equal ids share one."""
    x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)


def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]


class Cells:
    """What tasks share: the centres, the pivots of crowded cells as (ids, vectors), and the blocks of queries and of rows of each cell."""

    def __init__(self, centres: np.ndarray, probes: int, threshold: float):
        self.centres, self.probes, self.threshold = centres, probes, threshold
        self.pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.nq = self.nr = np.ones(len(centres), dtype=np.int64)

    def witnesses(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The smallest similar pivot of smaller id in a row's cells; the largest number where there is none."""
        out = np.full(len(ids), np.iinfo(np.int64).max)
        for cell in self.pivots.keys() & set(np.unique(near).tolist()):
            theirs, y = self.pivots[cell]
            rows = np.flatnonzero((near == cell).any(axis=1))
            hit = (np.round(x[rows] @ y.T, 6) >= self.threshold) & (theirs[None] < ids[rows][:, None])
            out[rows] = np.minimum(out[rows], np.where(hit, theirs[None], np.iinfo(np.int64).max).min(axis=1))
        return out


def cell_counts(shared):
    """(cell, asking, held): rows that are to be compared in a cell and not settled by its pivots, and rows whose home it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        asking, held = np.zeros(len(cells.centres), dtype=np.int64), np.zeros(len(cells.centres), dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = matrix(part.column(1))
                near = nearest(x, cells.centres, cells.probes)
                open_ = cells.witnesses(np.asarray(part.column(0)), x, near) == np.iinfo(np.int64).max
                asking += np.bincount(near[open_].ravel(), minlength=len(asking))
                held += np.bincount(near[:, 0], minlength=len(held))
        k = np.flatnonzero(asking + held)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(asking[k]), pa.array(held[k])], names=["cell", "asking", "held"])

    return run


def homes(shared, crowded: list[int]):
    """(cell, id, v) of the rows whose home is one of the crowded cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                cell = nearest(matrix(part.column(1)), cells.centres, 1)[:, 0]
                keep = pa.array(np.isin(cell, crowded))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), part.column(0), part.column(1)], names=["cell", "id", "v"]).filter(keep)

    return run


def settled(shared):
    """(id, witness) of the rows that a pivot settles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x, ids = matrix(part.column(1)), np.asarray(part.column(0))
                found = cells.witnesses(ids, x, nearest(x, cells.centres, cells.probes))
                ok = found < np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(found[ok])], names=["id", "witness"])

    return run


def dealt(shared):
    """Rows to (cell, i, j, asks, held, id, v): every block of a cell's queries meets every block of its rows.

    A row in its home cell is a query and a candidate, and goes once to the group in which it is both.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, ids = matrix(part.column(1)), np.asarray(part.column(0))
                near = nearest(x, cells.centres, cells.probes)
                open_ = cells.witnesses(ids, x, near) == np.iinfo(np.int64).max
                rows = []  # arrays of (row, cell, i, j, asks, held)
                for probe in range(near.shape[1]):
                    cell = near[:, probe]
                    i, j = lots(ids, cells.nq[cell], 1), lots(ids, cells.nr[cell], 2)
                    n = np.where(open_, cells.nr[cell], 0)
                    row = np.repeat(np.arange(len(ids)), n)
                    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    rows.append(np.stack([row, cell[row], i[row], step, np.ones_like(row), (step == j[row]) if probe == 0 else np.zeros_like(row)]))
                    if probe == 0:
                        n = cells.nq[cell]
                        row = np.repeat(np.arange(len(ids)), n)
                        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        own = open_[row] & (step == i[row])
                        row, step = row[~own], step[~own]
                        rows.append(np.stack([row, cell[row], step, j[row], np.zeros_like(row), np.ones_like(row)]))
                row, cell, i, j, asks, held = np.concatenate(rows, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(i), pa.array(j), pa.array(asks.astype(bool)), pa.array(held.astype(bool)), pa.array(ids[row]), part.column(1).take(pa.array(row))], names=["cell", "i", "j", "asks", "held", "id", "v"])

    return run


def earlier(threshold: float):
    """Rows (group, asks, held, id, v), group by group, to (id, witness): the smallest id of a candidate that is smaller than the query's and similar to it."""

    def compared(parts: list) -> pa.RecordBatch:
        asks, held, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
        x = np.concatenate([p[3] for p in parts])
        out, witness = [], []
        order = np.flatnonzero(held)[np.argsort(ids[held], kind="stable")]
        other, y, own = ids[order], x[order], np.flatnonzero(asks)
        for k in range(0, len(own) if len(order) else 0, 256):
            q = own[k : k + 256]
            hit = (np.round(x[q] @ y.T, 6) >= threshold) & (other[None] < ids[q][:, None])
            some = hit.any(axis=1)
            out.append(ids[q][some])
            witness.append(other[hit.argmax(axis=1)[some]])
        none = [np.zeros(0, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or none)), pa.array(np.concatenate(witness or none))], names=["id", "witness"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            groups = np.array(list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))).reshape(-1, 3)
            cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1
            for some in np.split(np.arange(len(groups)), cuts):
                if not len(some):
                    continue
                group = tuple(groups[some[0]])
                if group != at and parts:
                    yield compared(parts)
                    parts = []
                at, part = group, batch.slice(int(some[0]), len(some))
                parts.append([np.asarray(part.column(k)) if k == 5 else np.asarray(part.column(k).to_pylist(), dtype=bool) for k in (3, 4, 5)] + [matrix(part.column(6))])
        if parts:
            yield compared(parts)

    return run


def semantic_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.9, cells: int | None = None, rounds: int = ROUNDS, probes: int = PROBES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, witness, kept) of every row with an id: a row goes if a row of smaller id has a cosine (rounded to 6 places) of at least ``threshold``; ``witness`` is one such row.

    A row lies in the k-means cell of its nearest centre and is compared with all rows of its ``probes`` nearest cells: what is found is right, and pairs whose
    cells are further apart are missed (the tests measure the recall). In crowded cells every row first meets the smallest ids, which settles a group of near copies of
    any size in linear time; what that leaves meets all rows of its cells, block by block. Rows that take part in nothing are kept; of equal ids none is earlier.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    size = length_of(rows)
    rows = rows.where(F.size("v") == size)
    every = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"))
    n = rows.count()
    if not n:
        return every.select("id", F.lit(None).cast("long").alias("witness"), F.lit(True).alias("kept"))
    k = cells or max(1, min(-(-n // CELL), CENTRE_BYTES // (8 * size)))
    known = Cells(spherical_k_means(rows, k, rounds), probes, threshold)
    block = max(1, block_bytes // (8 * size))

    def counted() -> list:
        with_cells = spark.sparkContext.broadcast(known)
        out = rows.mapInArrow(cell_counts(with_cells), "cell long, asking long, held long").groupBy("cell").agg(F.sum("asking").alias("asking"), F.sum("held").alias("held")).collect()
        with_cells.destroy()
        return out

    crowded = [r.cell for r in counted() if r.held > max(CROWDED * n / len(known.centres), n / SHARE, block)]
    if crowded:
        shared = spark.sparkContext.broadcast(known)
        first = rows.mapInArrow(homes(shared, crowded), f"cell long, id long, v {rows.schema['v'].dataType.simpleString()}")
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("id", F.xxhash64("v")))).where(F.col("n") <= PIVOTS).toArrow()
        shared.destroy()
        at, ids, x = np.asarray(first.column("cell")), np.asarray(first.column("id")), matrix(first.column("v").combine_chunks())
        known.pivots = {c: (ids[at == c], x[at == c]) for c in crowded}
    known.nq, known.nr = known.nq.copy(), known.nr.copy()
    for r in counted():
        known.nq[r.cell], known.nr[r.cell] = max(1, -(-r.asking // block)), max(1, -(-r.held // block))
    shared = spark.sparkContext.broadcast(known)
    groups = rows.mapInArrow(dealt(shared), f"cell long, i long, j long, asks boolean, held boolean, id long, v {rows.schema['v'].dataType.simpleString()}")
    groups = groups.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = groups.mapInArrow(earlier(threshold), "id long, witness long").unionByName(rows.mapInArrow(settled(shared), "id long, witness long"))
    found = stored(found.groupBy("id").agg(F.min("witness").alias("witness")), "witnesses")
    shared.destroy()
    return every.join(found, "id", "left").select("id", "witness", F.col("witness").isNull().alias("kept"))
