"""Retrieval: search, rank metrics and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled(vectors: Column, mask: Column) -> Column:
    """L2-normalised mean of the token vectors whose mask is not 0."""
    used = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    n = F.greatest(F.size(used), F.lit(1)).cast("double")
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    mean = F.aggregate(used, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / n))
    with_norm = lambda m: F.struct(m.alias("m"), F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    # each step is bound to a lambda's variable so that it is computed once
    bound = F.transform(F.transform(F.array(mean), with_norm), lambda s: F.transform(s["m"], lambda x: x / F.greatest(s["n"], F.lit(1e-12))))
    return F.get(bound, F.lit(0))


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with an id and a vector of numbers only."""
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))
    return df.where(F.coalesce(fine, F.lit(False)))


def top_k(queries: DataFrame, pool: DataFrame, key: str, vector: str, k: int = 32, block: int = 1024) -> DataFrame:
    """(query, candidate, score, rank): the k largest inner products, rounded to 6 places; ties by the smaller id.

    Queries go in blocks of about ``block`` rows to all tasks of the pool; each task returns its best k of each query. Rows without an id,
    without a vector or with null or undefined components take no part.
    """
    spark = pool.sparkSession
    queries, pool = whole(queries, key, vector), whole(pool, key, vector)
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(F.col(key).cast("long").alias("q"), vector).toArrow()
        if not rows.num_rows:
            continue
        ids = np.asarray(rows.column("q"))
        shared = spark.sparkContext.broadcast((ids, np.array(rows.column(vector).to_pylist(), dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                theirs = np.asarray(batch.column(0))
                x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(theirs), -1)
                scores = np.round(q @ x.T, 6)
                for i in range(len(ids)):
                    s, c = np.append(best[i][0], scores[i]), np.append(best[i][1], theirs)
                    if len(s) > 4 * k:
                        part = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        s, c = s[part], c[part]
                    order = np.lexsort((c, -s))[:k]
                    best[i] = s[order], c[order]
            n = [len(s) for s, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([c for _, c in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query", "candidate", "score"])

        found = pool.select(F.col(key).cast("long"), vector).mapInArrow(run, "query long, candidate long, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate"))
    if out is None:
        return spark.createDataFrame([], "query long, candidate long, score double, rank int")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def counted_positions(queries: DataFrame, pool: DataFrame, key: str, vector: str, truth: Column, block: int = 4096) -> DataFrame:
    """(query, pos): 1 + the rows of the pool, the query's own aside, whose inner product, rounded to 6 places, exceeds that of ``truth`` (an id).

    Queries go in blocks of about ``block`` rows; a task only counts, so no ranking of all pairs is ever made. Queries without
    a true row have no position.
    """
    spark = pool.sparkSession
    theirs = pool.select(F.col(key).alias("__truth"), F.col(vector).alias("tv"))
    known = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("qv"), truth.alias("__truth")).join(theirs, "__truth").select("q", "qv", "tv")
    blocks = max(1, -(-known.count() // block))
    out = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        ids = np.asarray(rows.column("q"))
        q, own = (np.array(rows.column(c).to_pylist(), dtype=np.float64) for c in ("qv", "tv"))
        shared = spark.sparkContext.broadcast((ids, q, np.round((q * own).sum(axis=1), 6)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, own = shared.value
            above = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                other = np.asarray(batch.column(0))
                for i in range(0, len(other), 1024):
                    x = np.asarray(batch.column(1).slice(i, 1024).flatten(), dtype=np.float64).reshape(-1, q.shape[1])
                    above += ((np.round(q @ x.T, 6) > own[:, None]) & (other[None, i : i + 1024] != ids[:, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(above)], names=["query", "above"])

        found = pool.select(F.col(key).cast("long"), vector).mapInArrow(run, "query long, above long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query long, pos long")
    return out.groupBy("query").agg((F.sum("above") + 1).alias("pos"))


def positions(scored: DataFrame, query: str, candidate: str, score: str, truth: str) -> DataFrame:
    """(query, pos): 1 + the candidates that score higher than the true one (``truth``: its id); ties do not count."""
    own = scored.where(F.col(candidate) == F.col(truth)).groupBy(query).agg(F.max(score).alias("__own"))
    return scored.join(own, query).groupBy(query).agg((F.count_if(F.col(score) > F.col("__own")) + 1).alias("pos"))


def rank_metrics(ranks: DataFrame, pos: str = "pos", by: str | None = None) -> DataFrame:
    """recall@1, recall@10, MRR and nDCG@10 of one relevant item a query."""
    p = F.col(pos)
    gain = F.when(p <= 10, 1 / (F.log(p + 1) / math.log(2))).otherwise(0.0)
    grouped = ranks.groupBy(by) if by else ranks
    return grouped.agg(
        F.count("*").alias("n"),
        F.round(F.avg((p <= 1).cast("int")), 6).alias("recall_1"),
        F.round(F.avg((p <= 10).cast("int")), 6).alias("recall_10"),
        F.round(F.avg(1 / p), 6).alias("mrr"),
        F.round(F.avg(gain), 6).alias("ndcg_10"),
    )


def group_metrics(ranks: DataFrame, pos: str, size: str) -> DataFrame:
    """Top-1 accuracy and MRR inside groups, and what chance gives."""
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg((F.col(pos) == 1).cast("int")), 6).alias("top_1"), F.round(F.avg(1 / F.col(pos)), 6).alias("mrr"), F.round(F.avg(1 / F.col(size)), 6).alias("chance"))


def binomial_p(less: int, more: int) -> float:
    """Two-sided exact probability of so uneven discordant pairs under a fair coin."""
    n, k = less + more, min(less, more)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top + math.log(sum(math.exp(x - top) for x in logs))))


def paired_counts(a: DataFrame, b: DataFrame, query: str, pos: str = "pos", at: int = 1) -> DataFrame:
    """One row: queries of each side and both, and those only one side has within ``at``."""
    both = a.select(query, F.col(pos).alias("pa")).join(b.select(query, F.col(pos).alias("pb")), query, "full_outer")
    hit_a, hit_b = F.col("pa") <= at, F.col("pb") <= at
    return both.agg(F.count("pa").alias("n_a"), F.count("pb").alias("n_b"), F.count_if(hit_a & ~hit_b).alias("only_a"), F.count_if(hit_b & ~hit_a).alias("only_b"))


def mcnemar(a: DataFrame, b: DataFrame, query: str, pos: str = "pos", least: int = 20, alpha: float = 0.05) -> dict:
    """Exact McNemar test of two systems on the same queries; undecided below ``least`` discordant ones."""
    row = paired_counts(a, b, query, pos).first()
    if row.n_a != row.n_b:
        raise ValueError("the two sides have different queries")
    p, n = binomial_p(row.only_a, row.only_b), row.only_a + row.only_b
    verdict = "undecided" if n < least or p >= alpha else "a" if row.only_a > row.only_b else "b"
    return {"only_a": row.only_a, "only_b": row.only_b, "p": p, "verdict": verdict}


#: Margin over the rival of the same domain, and how much larger a beaten general model must be.
MARGIN, SIZE_RATIO = 0.05, 10.0


def champion(results: list[dict]) -> dict | None:
    """The best of our models by the gate's own metric."""
    ours = [r for r in results if r.get("ours") and not r.get("error")]
    return max(ours, key=lambda r: r["ndcg_10"], default=None)


def gate(results: list[dict], rival: str, general: set[str]) -> dict[str, str]:
    """Verdicts "passed", "failed", "partial" or "undetermined" of both criteria; margins are judged as shown, to 3 places."""
    ours, fine = champion(results), [r for r in results if not r.get("error")]
    if ours is None:
        return {"domain": "undetermined", "general": "undetermined"}
    target = next((r for r in fine if r["path"] == rival), None)
    domain = "undetermined" if target is None else "passed" if round(ours["ndcg_10"] - target["ndcg_10"], 3) >= MARGIN else "failed"
    best = max((r for r in fine if r["path"] in general), key=lambda r: r["ndcg_10"], default=None)
    if best is None:
        return {"domain": domain, "general": "undetermined"}
    beats = ours["ndcg_10"] > best["ndcg_10"]
    fits = best["params_m"] / max(ours["params_m"], 1e-9) >= SIZE_RATIO
    return {"domain": domain, "general": "passed" if beats and fits else "partial" if beats else "failed"}


def usable_cache(cache: DataFrame, protocol: dict) -> DataFrame:
    """Cached results of exactly this protocol (all or nothing by digest, size and token limit)."""
    out = cache
    for name in ("digest", "n", "max_tokens"):
        out = out.where(F.col(name) == F.lit(protocol[name]))
    return out


def cached_vectors(cache: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of the wanted ids that are in the cache, wanted rows that are not): joined by id, so order and count of the cache do not matter."""
    ids = wanted.select(key).distinct()
    return cache.join(ids, key, "left_semi"), wanted.join(cache.select(key).distinct(), key, "left_anti")
