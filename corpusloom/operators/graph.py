"""Citation pairs, negatives and co-citation over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded
from .spine import capped

NO_NEGATIVE = "__sem_negativo__"  # fixed value: marks a missing negative in batch masks


def resolve_edges(edges: DataFrame, works: DataFrame, src: str, dst: str, work_id: str, key: str) -> DataFrame:
    """Edges (src, work id) to edges between keys; targets that are no known work, self-citations and repetitions go."""
    known = works.where(F.col(key).isNotNull()).select(F.col(work_id).alias(dst), F.col(key).alias("__to")).distinct()
    return edges.select(src, dst).join(known, dst).where(F.col(src) != F.col("__to")).select(src, F.col("__to").alias(dst)).distinct()


def cap_per_anchor(edges: DataFrame, src: str, dst: str, n: int = 8, seed: int = 17) -> DataFrame:
    """At most n targets of each source, by the targets' seeded hash."""
    return capped(edges, src, [seeded(seed, F.col(dst)), F.col(dst)], n)


def citation_pairs(edges: DataFrame, texts: DataFrame, src: str, dst: str, key: str, text: str, cap: int = 8, least: int = 120, seed: int = 17) -> DataFrame:
    """(src, dst, anchor, positive): capped distinct edges between texts of at least ``least`` characters."""
    usable = texts.where(F.length(text) >= least).select(F.col(key), F.col(text))
    distinct = edges.select(src, dst).where(F.col(src) != F.col(dst)).distinct()
    picked = cap_per_anchor(distinct, src, dst, cap, seed)
    left = usable.select(F.col(key).alias(src), F.col(text).alias("anchor"))
    right = usable.select(F.col(key).alias(dst), F.col(text).alias("positive"))
    return picked.join(left, src).join(right, dst).select(src, dst, "anchor", "positive")


def cited_sets(edges: DataFrame, by: str, member: str, name: str) -> DataFrame:
    """Sorted distinct members of each key."""
    return edges.groupBy(by).agg(F.array_sort(F.collect_set(member)).alias(name))


def attach_forbidden(pairs: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Left join of all targets that a pair's source cites; as many rows as before."""
    return pairs.join(cited_sets(edges, src, dst, "forbidden"), src, "left")


def members_only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of ids; Spark picks a broadcast only if the ids are known to be few."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def exclude_cited(candidates: DataFrame, edges: DataFrame, src: str, cand: str, dst: str, score: str, keep: int = 8) -> DataFrame:
    """Ranked candidates (src, cand, score) without those the source cites and itself; the best ``keep`` of each source, ranks renewed."""
    known = edges.select(F.col(src), F.col(dst).alias(cand)).distinct()
    left = candidates.where(F.col(src) != F.col(cand)).join(known, [src, cand], "left_anti")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(src).orderBy(F.col(score).desc(), cand))
    return left.withColumn("rank", rank).where(F.col("rank") <= keep)


def negative_statistics(candidates: DataFrame, kept: DataFrame, sources: DataFrame, src: str) -> DataFrame:
    """One row: candidates, kept negatives, dropped ones, sources without any."""
    without = sources.select(src).distinct().join(kept.select(src).distinct(), src, "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(candidates, "candidates").crossJoin(one(kept, "kept")).crossJoin(one(without, "without_negative")).withColumn("dropped", F.col("candidates") - F.col("kept"))


def drop_cocited(negatives: DataFrame, edges: DataFrame, positive: str, negative: str, citer: str, cited: str) -> DataFrame:
    """Rows of (positive, negative) that no paper cites together.

    The pairs that are asked for, not all co-cited pairs, are looked up: each is joined with the citers of its
    positive and these with their citations of its negative.
    """
    asked = negatives.select(positive, negative).distinct()
    by = edges.select(citer, cited).distinct()
    hit = asked.join(by.withColumnRenamed(cited, positive), positive)
    hit = hit.join(by.withColumnRenamed(cited, negative), [citer, negative], "left_semi").select(positive, negative).distinct()
    return negatives.join(hit, [positive, negative], "left_anti")


def attach_texts(ranked: DataFrame, texts: DataFrame, src: str, cand: str, key: str, text: str, rank: str = "rank") -> DataFrame:
    """Candidates and their texts as lists of each source, in rank order."""
    rows = ranked.join(texts.select(F.col(key).alias(cand), F.col(text).alias("__t")), cand)
    packed = rows.groupBy(src).agg(F.array_sort(F.collect_list(F.struct(rank, F.col(cand).alias("id"), F.col("__t").alias("t")))).alias("l"))
    return packed.select(src, F.col("l.id").alias("negative_ids"), F.col("l.t").alias("negatives"))


def batch_mask(batches: DataFrame, batch: str, row: str, negative: str, forbidden: str) -> DataFrame:
    """(batch, row, other, masked): whether the negative of row ``other`` must not count for ``row`` of the same batch.

    Batches are small by definition; the join is on the batch.
    """
    left = batches.select(batch, row, F.col(forbidden).alias("__f"))
    right = batches.select(batch, F.col(row).alias("other"), F.col(negative).alias("__n"))
    masked = F.coalesce(F.array_contains("__f", F.col("__n")), F.lit(False)) | (F.col("__n") == NO_NEGATIVE)
    return left.join(right, batch).select(batch, row, "other", masked.alias("masked"))


def rerank_group(positive: Column, negatives: Column, size: int, key: Column, seed: int = 17) -> Column:
    """[positive, size negatives]: a seeded sample of enough, else the list over and over, else the positive."""
    shuffled = F.transform(F.array_sort(F.transform(negatives, lambda x: F.struct(seeded(seed, key, x).alias("h"), x.alias("x")))), lambda s: s["x"])
    cycled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(negatives, F.pmod(i, F.greatest(F.size(negatives), F.lit(1)))))
    tail = F.when(F.size(negatives) >= size, F.slice(shuffled, 1, size)).when(F.size(negatives) > 0, cycled).otherwise(F.array_repeat(positive, size))
    return F.concat(F.array(positive), F.coalesce(tail, F.array_repeat(positive, size)))
