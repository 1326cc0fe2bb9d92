"""A linear classifier with the modified Huber loss whose gradients are added up by tasks (M1, M2).

Texts become hashed 1- and 2-grams with sublinear counts, inverse document frequency and unit length; document frequencies are counted by Spark and, as there are at most 2^BITS of
them, shared with all tasks. Each step of the optimiser (L-BFGS) sends the weights to the tasks, which add up loss and gradient over their rows; the gradient comes back in slices, each
added up in one task, so the driver gets one gradient whatever the number of tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Tables

#: Hashed features, slices of a gradient, strength of the penalty; steps, and vectors that the optimiser remembers.
BITS, SLICES, ALPHA = 18, 64, 1e-4
STEPS, MEMORY = 30, 8
WORD = re.compile(r"(?u)\b\w\w+\b")
ROWS = "doc long, at array<int>, tf array<double>, y int, weight double"


def plain(text: str | None) -> str:
    """Lower case without accents."""
    text = (text or "").lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def grams(text: str | None) -> list[str]:
    words = WORD.findall(plain(text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def hashed(names: list[str], bits: int) -> np.ndarray:
    """A feature for each gram: the same in every task and session."""
    from hashlib import blake2b

    return np.array([int.from_bytes(blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ((1 << bits) - 1) for n in names], dtype=np.int64)


def counted(bits: int):
    """(doc, text, y, weight) to features with 1 + ln(count), by feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ats, tfs = [], []
                for text in part.column(1).to_pylist():
                    names = grams(text)
                    new = [n for n in set(names) if n not in known]
                    if len(known) + len(new) > 500_000:
                        known, new = {}, list(set(names))
                    known.update(zip(new, hashed(new, bits).tolist(), strict=True))
                    at, n = np.unique(np.fromiter((known[n] for n in names), dtype=np.int64, count=len(names)), return_counts=True)
                    ats.append(at.astype(np.int32))
                    tfs.append(1 + np.log(n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ats, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.float64())), part.column(2), part.column(3)], names=["doc", "at", "tf", "y", "weight"])

    return run


@dataclass
class Rows:
    """Unit rows as flat arrays: row ``r`` has the features ``at[b[r]:b[r + 1]]``."""

    at: np.ndarray
    x: np.ndarray
    of: np.ndarray
    n: int

    @classmethod
    def of_batch(cls, batch: pa.RecordBatch, idf: np.ndarray) -> Rows:
        at, tf = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
        n = batch.num_rows
        of = np.repeat(np.arange(n), np.diff(np.asarray(batch.column(1).offsets)))
        x = tf * idf[at]
        length = np.sqrt(np.bincount(of, weights=x * x, minlength=n))
        return cls(at, x / np.maximum(length, 1e-300)[of], of, n)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """(classes, rows); the last weight of a class is its bias."""
        return np.stack([np.bincount(self.of, weights=self.x * own[:-1][self.at], minlength=self.n) + own[-1] for own in w])


def loss_of(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The modified Huber loss of margins y f and its derivative: (1 - m)^2 above -1, -4 m below, nothing from 1 on."""
    inside = np.maximum(0.0, 1 - margin)
    return np.where(margin >= -1, inside**2, -4 * margin), np.where(margin >= -1, -2 * inside, -4.0)


def partial_gradient(shared):
    """(doc, at, tf, y, weight) to slices of the task's loss and gradient."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w = shared.value
        loss, total = 0.0, np.zeros_like(w)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if c.offset == 0 else c.take(pa.array(np.arange(len(c)))) for c in part.columns], names=part.schema.names)
                rows = Rows.of_batch(part, idf)
                y, weight = np.asarray(part.column(3)), np.asarray(part.column(4))
                f = rows.scores(w)
                for k in range(len(w)):
                    sign = np.where(y == (k if len(w) > 1 else 1), 1.0, -1.0)
                    own, slope = loss_of(sign * f[k])
                    g = weight * slope * sign
                    loss += float((weight * own).sum())
                    total[k, :-1] += np.bincount(rows.at, weights=g[rows.of] * rows.x, minlength=w.shape[1] - 1)
                    total[k, -1] += g.sum()
        flat = np.append(total.ravel(), loss)
        parts = np.array_split(flat, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["slice", "v"])

    return run


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            k, v = batch.column(0)[i].as_py(), np.asarray(batch.column(1)[i].values)
            sums[k] = v.copy() if k not in sums else sums[k] + v
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["slice", "v"])


def gradient(rows: DataFrame, idf: np.ndarray, w: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows (their weights add up to 1), with the penalty on all weights but the biases."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, w))
    parts = rows.mapInArrow(partial_gradient(shared), "slice int, v array<double>").repartition(SLICES, "slice").mapInArrow(added, "slice int, v array<double>").toArrow()
    shared.destroy()
    if not parts.num_rows:
        return 0.0, np.zeros_like(w)
    flat = np.concatenate([np.asarray(v) for _, v in sorted(zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True))])
    penalty = w.copy()
    penalty[:, -1] = 0
    return float(flat[-1]) + alpha / 2 * float((penalty**2).sum()), flat[:-1].reshape(w.shape) + alpha * penalty


def minimised(of: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = MEMORY) -> np.ndarray:
    """L-BFGS with halved steps until the loss falls enough."""
    loss, g = of(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s * d).sum() / (s * y).sum()
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + (a - (y * d).sum() / (s * y).sum()) * s
        slope = float((g * d).sum())
        if slope > -1e-10:
            break
        size = 1.0
        while True:
            trial = w + size * d
            new, after = of(trial)
            if new <= loss + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if new >= loss:
            break
        if ((trial - w) * (after - g)).sum() > 1e-12:
            pairs = [*pairs, (trial - w, after - g)][-memory:]
        close = loss - new < 1e-7 * max(1.0, abs(loss))
        w, loss, g = trial, new, after
        if close:
            break
    return w


@dataclass
class Model:
    """``w``: a row of weights and a bias for each class, one row for two classes; ``idf`` is 0 for features of fewer than ``min_df`` documents."""

    w: np.ndarray
    idf: np.ndarray
    bits: int


def train(df: DataFrame, text: str = "text", label: str = "label", classes: int = 2, min_df: int = 3, alpha: float = ALPHA, steps: int = STEPS, bits: int = BITS) -> Model:
    """Fit on the rows whose label is 0 to ``classes`` - 1, all classes counting alike; null texts are empty, other rows are left out."""
    spark = df.sparkSession
    rows = df.where(F.col(label).between(0, classes - 1)).select(F.monotonically_increasing_id().alias("doc"), F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, 1.0 / (len(sizes) * n)).otherwise(share)
    with Tables(spark) as tables:
        table = tables.stored(rows.withColumn("weight", share).mapInArrow(counted(bits), ROWS), "features") if sizes else None
        n, found = sum(sizes.values()), np.zeros(1 << bits, dtype=np.int64)
        if table is not None:
            df_of = table.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).toArrow()  # at most 2^bits rows
            found[np.asarray(df_of.column("at"))] = np.asarray(df_of.column("n"))
        idf = np.where(found >= min_df, np.log((1 + n) / (1 + found)) + 1, 0.0)
        w = np.zeros((1 if classes == 2 else classes, (1 << bits) + 1))
        if len(sizes) > 1:
            w = minimised(lambda v: gradient(table, idf, v, alpha), w, steps)
    return Model(w, idf, bits)


def scored(model: Model, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p): the probabilities of the classes, (clipped score + 1) / 2, of several classes in shares; rows that no class claims have equal ones."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers for each class

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in counted(own.bits)(batches):
            f = (np.clip(Rows.of_batch(batch, own.idf).scores(own.w), -1, 1) + 1) / 2
            p = np.stack([1 - f[0], f[0]]) if len(f) == 1 else np.where(f.sum(axis=0) > 0, f / np.maximum(f.sum(axis=0), 1e-300), 1 / len(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p.T), pa.list_(pa.float64()))], names=[key, "p"])

    rows = df.select(F.col(key).cast("long"), text, F.lit(0).alias("y"), F.lit(0.0).alias("weight"))
    return rows.mapInArrow(run, f"`{key}` long, p array<double>")
