"""Paired rank tests and false discovery rates over values of any number: global ranks without sorting all rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Tables, new_path, stored

#: The polynomial of Abramowitz and Stegun 7.1.26 for the complementary error function, right to 1.5e-7.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_P = 0.3275911


def two_sided_p(z: Column) -> Column:
    """The probability of a standard normal value beyond |z| on either side."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERFC_P * x)
    series = F.lit(0.0)
    for c in reversed(ERFC):
        series = (series + c) * t
    return series * F.exp(-x * x)


def tie_groups(values: DataFrame, value: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """(by, value, n, before): each value's rows and the rows of smaller values, within ``by`` if given; and the path of a table that it reads.

    Equal values are counted first. What is left is dealt by ranges of (by, value): a task adds up its own range, and the sums of the ranges before it, one row for each range and
    group that it holds, are added. No task sees more than its range, however large a group is.
    """
    by = by or []
    counted = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id())
    path = new_path(values.sparkSession, "ranges")
    table = stored(dealt, "ranges", path)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy(*by, "part").agg(F.sum("n").alias("own")).withColumn("offset", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    inside = Window.partitionBy("part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["part", *by]]
    ranged = table.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = ranged.alias("l").join(offsets.select("part", *by, "offset").alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in [*by, value, "n"]], (F.col("offset") + F.col("within")).alias("before")), path


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``rank``: from 1, equal values share the mean of their places; rows without a value have none. A table stays for the result to read."""
    groups, _ = tie_groups(df.where(F.col(value).isNotNull()), value)
    ranks = groups.select(value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    return df.join(ranks, value, "left").select(*df.columns, "rank")


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, zero, w_plus, w_minus, z, p): Wilcoxon's signed-rank test of the differences a - b.

    Pairs without a difference are left out and counted; equal differences share their mean rank, and the variance is corrected for them; p is the normal
    approximation on both sides (null, as z is, where no difference is left). Pairs with a null are left out.
    """
    d = F.col(a) - F.col(b)
    rows = pairs.where(d.isNotNull()).select(F.abs(d).alias("size"), F.when(d > 0, 1).otherwise(0).alias("up"))
    with Tables(pairs.sparkSession) as tables:
        groups, path = tie_groups(rows.where("size > 0"), "size")
        tables.paths.append(path)
        ups = rows.where("size > 0").groupBy("size").agg(F.sum("up").alias("ups"))
        rank = F.col("before") + (F.col("n") + 1) / 2
        n = F.col("n")
        sums = groups.join(ups, "size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(rank * F.col("ups")).alias("w_plus"), F.sum(rank * (n - F.col("ups"))).alias("w_minus"), F.sum((n * n * n - n).cast("double")).alias("ties"))
        zero = rows.agg(F.count_if(F.col("size") == 0).alias("zero"))
        one = tables.kept(sums.crossJoin(F.broadcast(zero)), "wilcoxon")  # a row each
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    return one.select("n", "zero", "w_plus", "w_minus", z.alias("z"), two_sided_p(z).alias("p"))


def false_discovery(tests: DataFrame, p: str, level: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """``tests`` with ``q`` and ``rejected`` (q at most ``level``): Benjamini and Hochberg's corrected p within each family.

    q of the i-th smallest of m is the least p(j) m / j over all j from i on; equal p share one q. Tests without a p (null, undefined) have no q, are not rejected and do
    not count in m. The least of the ranges after a value's own is carried backwards, so a family of any size takes no task of its own.
    """
    by = family or []
    fine = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    groups, path = tie_groups(tests.where(fine).select(*by, F.col(p).alias("p")), "p", by)
    with Tables(tests.sparkSession) as tables:
        tables.paths.append(path)
        m = tests.where(fine).groupBy(*by).agg(F.count("*").alias("m"))
        same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names] or F.lit(True)
        raw = groups.alias("g").join(F.broadcast(m).alias("m") if not by else m.alias("m"), same("g", "m", by)).select(*[F.col(f"g.{c}") for c in by], "g.p", (F.col("p") * F.col("m") / (F.col("before") + F.col("n"))).alias("raw"))
        dealt = tables.stored(raw.repartitionByRange(*by, "p").withColumn("part", F.spark_partition_id()), "raw")
        later = Window.partitionBy(*by).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        least = dealt.groupBy(*by, "part").agg(F.min("raw").alias("own")).withColumn("after", F.min("own").over(later))
        inside = Window.partitionBy("part", *by).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
        q = F.least(F.min("raw").over(inside), F.lit(1.0))
        found = dealt.withColumn("own_q", q).alias("d").join(least.alias("l"), same("d", "l", ["part", *by])).select(*[F.col(f"d.{c}").alias(f"__{c}") for c in by], F.col("d.p").alias("__p"), F.least("d.own_q", F.coalesce("l.after", F.lit(1.0))).alias("q"))
        found = tables.kept(found, "corrected")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(p) == F.col("__p")]
    return tests.join(found, on, "left").select(*tests.columns, "q", F.coalesce(F.col("q") <= level, F.lit(False)).alias("rejected"))
