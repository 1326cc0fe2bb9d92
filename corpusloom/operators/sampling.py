"""Reproducible samples, caps and splits by seeded hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ._tables import Tables
from .spine import capped


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """The n rows of the smallest seeded hash, the same whatever the order of the input (a sort that keeps n rows)."""
    return df.withColumn("__h", seeded(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def stratified_cap(df: DataFrame, key: str, stratum: str, total: int, n_strata: int, seed: int = 17) -> DataFrame:
    """At most ceil(total / n_strata) rows of each stratum, by seeded hash; what a stratum lacks is not given to others."""
    quota = math.ceil(total / n_strata)
    return capped(df, stratum, [seeded(seed, F.col(key)), F.col(key)], quota)


def head_tail_split(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """Rows marked "train" (first n by seeded hash) or "test" (last n); the two never overlap: a short table gives test the rest."""
    h = seeded(seed, F.col(key))
    marked = df.withColumn("__h", h)
    first = marked.orderBy("__h", key).limit(n).withColumn("split", F.lit("train"))
    last = marked.join(first.select(key), key, "left_anti").orderBy(F.col("__h").desc(), F.col(key).desc()).limit(n).withColumn("split", F.lit("test"))
    return first.unionByName(last).drop("__h")


def split_by_anchor(pairs: DataFrame, anchor: str, share: float = 0.02, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of pairs; an anchor's pairs stay together. A share of the anchors by hash, at least one anchor.

    The order is over anchors, not pairs; the validation anchors are the first of it, so no window over the whole table is needed.
    """
    anchors = pairs.select(anchor).distinct()
    n = max(1, int(anchors.count() * share))
    held = anchors.orderBy(seeded(seed, F.col(anchor)), anchor).limit(n)
    return pairs.join(held, anchor, "left_anti"), pairs.join(held, anchor, "left_semi")


def leaked(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Rows of validation whose key is in train; a sound split has none."""
    return validation.join(train.select(key).distinct(), key, "left_semi")


def union_keep_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, of each key that of the earliest table, then of the smallest columns."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("__at", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in frames[0].columns if c != key]
    if not rest:
        return out.select(key).distinct()
    picked = out.groupBy(key).agg(F.min(F.struct("__at", *rest)).alias("r"))
    return picked.select(*[key if c == key else F.col(f"r.`{c}`").alias(c) for c in frames[0].columns])


def labelled_set(positives: DataFrame, negatives: dict[str, DataFrame], key: str, per_class: int, seed: int = 17) -> DataFrame:
    """Positives and negatives with a label: negatives that are positives go first, then each domain is capped.

    The positives' ids decide (anti-join before the cap), each domain's quota is a ceiling, and both unions keep
    the first table's row.
    """
    clean = [df.join(positives.select(key), key, "left_anti").withColumn("domain", F.lit(name)) for name, df in sorted(negatives.items())]
    pool = union_keep_first(clean, key)
    taken = stratified_cap(pool, key, "domain", per_class, len(negatives), seed).withColumn("label", F.lit(0))
    good = hash_sample(positives.dropDuplicates([key]), key, per_class, seed).withColumn("domain", F.lit("positive")).withColumn("label", F.lit(1))
    return good.unionByName(taken)


def review_sample(df: DataFrame, key: str, accepted: Column, every: int = 97, most: int = 400) -> DataFrame:
    """Of rows in key order, each ``every``-th that is accepted, at most ``most``.

    Positions come from a count by key range and one inside each range, so no task sorts the whole table. The ranges are drawn from a
    sample that is not the same in two runs, so what is dealt is stored and both counts read that. Keys that are null come last.
    """
    order = F.col(key).asc_nulls_last()
    dealt = df.withColumn("__ok", accepted).repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    with Tables(df.sparkSession) as tables:
        ranged = tables.stored(dealt, "ranges")
        sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
        starts = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__start"))  # a row a range
        place = F.row_number().over(Window.partitionBy("__p").orderBy(order)) + F.col("__start")
        out = ranged.join(F.broadcast(starts), "__p").withColumn("__place", place)
        out = tables.kept(out.where((F.col("__place") % every == 0) & F.col("__ok")).orderBy("__place").limit(most), "review")  # at most ``most`` rows
    return out.orderBy("__place").drop("__p", "__ok", "__start", "__place")


def calendar_slices(spark, start: str, end: str) -> DataFrame:
    """(slice_from, slice_until): contiguous slices by civil year, both ends inclusive."""
    years = spark.sql(f"SELECT explode(sequence(year(DATE'{start}'), year(DATE'{end}'))) AS y")
    return years.select(
        F.date_format(F.greatest(F.make_date("y", F.lit(1), F.lit(1)), F.lit(start).cast("date")), "yyyy-MM-dd").alias("slice_from"),
        F.date_format(F.least(F.make_date("y", F.lit(12), F.lit(31)), F.lit(end).cast("date")), "yyyy-MM-dd").alias("slice_until"),
    )
