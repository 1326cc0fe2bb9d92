"""The keyed table of records: latest version, annotations, citations and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import licensing, taxonomy


def keep_latest(df: DataFrame, key: str, stamp: str, *tiebreak: str) -> DataFrame:
    """One row of each key: the latest stamp, then the largest tiebreak columns; nulls come last.

    An aggregate with partial sums, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in (stamp, *tiebreak)], *[F.col(c) for c in rest if c not in (stamp, *tiebreak) and not dict(df.dtypes)[c].startswith("map")])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def annotate(df: DataFrame) -> DataFrame:
    """License, partition and taxonomy columns; only native expressions."""
    out = df.withColumns({
        "spdx_id": licensing.spdx_id(F.col("license")),
        "partition": licensing.partition(F.col("license")),
        "archive": taxonomy.archive(F.col("primary_category")),
        "archives": taxonomy.archives(F.col("categories")),
        "is_physics": taxonomy.is_physics(F.col("categories")),
        "is_math_support": taxonomy.is_math_support(F.col("categories")),
        "peer_reviewed": F.col("journal_ref").isNotNull(),
        "year": taxonomy.lenient_year(F.col("created")),
    })
    return out.withColumn("subfield", taxonomy.subfield(F.col("archive")))


def attach_citations(df: DataFrame, works: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Left join of reference and citation counts; of several works of one key, the most cited, then the smallest id."""
    order = F.struct(F.coalesce("cited_by_count", F.lit(-1)), F.coalesce("n_references", F.lit(-1)))
    one = works.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("n_references", "cited_by_count"), order).alias("w"))
    return df.join(one.select(key, "w.n_references", "w.cited_by_count"), key, "left")


def build_spine(records: DataFrame, works: DataFrame | None = None) -> DataFrame:
    out = annotate(keep_latest(records, "arxiv_id", "datestamp", "updated"))
    if works is None:
        return out.withColumns({"n_references": F.lit(None).cast("int"), "cited_by_count": F.lit(None).cast("int")})
    return attach_citations(out, works)


def value_counts(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Rows and percentage by value, most frequent first; the total is a second aggregate over the counts."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    out = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(by, "n", F.round(100 * F.col("n") / F.col("__all"), 4).alias("pct"))
    out = out.orderBy(F.col("n").desc(), by)
    return out.limit(top) if top else out


def bucket_share(df: DataFrame, bucket: Column, holds: Column, least: int = 100) -> DataFrame:
    """Rows and the share for which a condition holds, by bucket; buckets of fewer than ``least`` rows are hidden."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(holds.cast("int")), 6).alias("share")).where(F.col("n") >= least)


def summary(df: DataFrame, counts: dict[str, Column], shares: dict[str, Column]) -> DataFrame:
    """One row: rows, how many rows conditions hold for, and the shares for which others hold."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()], *[F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in shares.items()])


def completion_marker(df: DataFrame, part: str, edges: str, open_value: str) -> DataFrame:
    """One row: rows by partition as a map, the sum of edges and the percentage of one partition."""
    counts = df.groupBy(part).agg(F.count("*").alias("n"), F.sum(edges).alias("e"))
    return counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(part, "n")))).alias("partitions"),
        F.sum("e").alias("edges"),
        F.round(100 * F.sum(F.when(F.col(part) == open_value, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("open_pct"),
    )


def capped(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
