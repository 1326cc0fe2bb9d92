"""Line de-duplication with levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. What earlier batches have seen lies in runs of (key hash,
first document), bucketed and sorted by the hash; two runs of one level are compacted into one of the next. A new
batch's keys are sorted once and merge-joined with the runs, which are never shuffled or sorted again: keys that no
run holds become a run of their own, and a line goes if a smaller document holds its key. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, free_name, read_table, set_for, shuffle_parts, stored

#: Stripped from both ends of a line before it is compared.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1
SEEDS = (7919, 104729)
#: Batches at least and at most, and the bytes of input in a batch and a shuffle partition, between them.
MIN_BATCHES, MAX_BATCHES, BATCH_BYTES = 4, 64, 64 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; ASCII texts take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs: ``levels[k]`` is a run of about 2**k batches, or None. No key is in two runs."""

    def __init__(self, scratch: Scratch, parts: int):
        self.scratch, self.parts = scratch, parts
        self.levels: list[DataFrame | None] = []

    def sorted(self, rows: DataFrame, name: str) -> DataFrame:
        return self.scratch.bucketed(rows, name, self.parts, "h1", "h2")

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (a bucketed table) with ``seen``: the first document of its key in the runs, null for a new key."""
        marks = []
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("first_id", f"seen_{i}").hint("merge"), ["h1", "h2"], "left")
            marks.append(f"seen_{i}")
        found = F.coalesce(*[F.col(m) for m in marks]) if marks else F.lit(None).cast("long")
        return keys.withColumn("seen", found).drop(*marks)

    def add(self, run: DataFrame) -> None:
        """Put a run (bucketed) of new keys at the lowest level; two of one level are merged."""
        level = 0
        while level < len(self.levels) and self.levels[level] is not None:
            old, self.levels[level] = self.levels[level], None
            both = old.withColumnRenamed("first_id", "f").hint("merge").join(run, ["h1", "h2"], "full")
            run = self.sorted(both.select("h1", "h2", F.coalesce("f", "first_id").alias("first_id")), "line-run")
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run


def batches_of(docs: DataFrame) -> int:
    """How many batches: each holds about BATCH_BYTES of the input, as the plan estimates it, in every shuffle partition."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(MIN_BATCHES, min(MAX_BATCHES, -(-size // (BATCH_BYTES * shuffle_parts(docs.sparkSession)))))


def repeated_lines(own: DataFrame, runs: LineRuns) -> DataFrame:
    """(oid, th, pos) of the batch's lines (oid, th, pos, h1, h2) that a smaller document holds; its new keys become a run.

    Keys of more lines than a partition should have are looked up in a broadcast table of at most as many rows as there are partitions.
    """
    keys = runs.sorted(own.groupBy("h1", "h2").agg(F.min("oid").alias("first_id"), F.count("*").alias("n")), "line-batch")
    known = runs.seen(keys)
    again = known.where("seen is not null or n > 1").select("h1", "h2", F.coalesce("seen", "first_id").alias("first_id"), "n")
    most = (keys.agg(F.sum("n")).first()[0] or 0) // runs.parts + 1
    hot = runs.scratch.stored(again.where(F.col("n") > most).drop("n"), "line-hot")
    usual = own.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(again.where(F.col("n") <= most).drop("n").hint("merge"), ["h1", "h2"])
    crowded = own.join(F.broadcast(hot), ["h1", "h2"])
    found = runs.scratch.stored(usual.unionByName(crowded).where("first_id < oid").select("oid", "th", "pos"), "line-found")
    runs.add(runs.sorted(known.where("seen is null").select("h1", "h2", "first_id"), "line-run"))
    return found


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, n_batches: int | None = None) -> DataFrame:
    """``docs`` with the text left after de-duplication, plus ``n_lines`` and ``n_dropped``.

    A line is compared by its key: A-Z in lower case, ASCII white space stripped. A key of at least
    ``min_chars`` code points that at least two documents hold loses its lines everywhere but in the
    smallest document id; there every repetition stays. Null and empty texts are one empty line (the
    text becomes empty). Rows of one id are one document; rows without an id count as the
    document after all others. Further columns stay; an ``n_lines`` or ``n_dropped`` in the input is
    replaced. An empty table gives an empty table. ``n_batches`` splits the ids into ranges of about as
    many documents (by the input's size if not given); the result does not depend on it. A text of any length takes time in proportion to it.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    oid, th, gone, lines = free_name(docs, "oid", "th", "gone", "lines")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    n_batches = n_batches or batches_of(docs)
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / n_batches for k in range(1, n_batches)], 10000)).first()[0] if n_batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("oid") > F.lit(cut)).cast("int")

    key = lambda line: F.btrim(line, F.lit(WHITE))
    keyed = lambda line: F.when(F.length(key(line)) >= min_chars, F.struct(F.xxhash64(F.lit(SEEDS[0]), key(line)).alias("h1"), F.xxhash64(F.lit(SEEDS[1]), key(line)).alias("h2")))
    table = docs.select(ident.alias("oid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), ascii_lower(F.col(text_col)).alias("low"))
    table = table.select("oid", "th", batch.alias("batch"), F.transform(lines_of(F.col("low")), keyed).alias("keys"))
    # a bucketed table has one file a bucket, so its scan may say that it is sorted
    with Scratch(spark) as scratch, set_for(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
        table = scratch.stored(table, "line-keys", ["batch"])
        runs, dropped = LineRuns(scratch, shuffle_parts(spark)), []
        for k in range(len(cuts) + 1):
            own = table.where(F.col("batch") == k).select("oid", "th", F.posexplode("keys").alias("pos", "key")).where("key is not null")
            dropped.append(repeated_lines(own.select("oid", "th", "pos", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")), runs))
        dropped = reduce(DataFrame.unionByName, dropped).groupBy("oid", "th").agg(F.collect_set("pos").alias("gone"))
        dropped = stored(dropped.select(F.col("oid").alias(oid), F.col("th").alias(th), F.col("gone").alias(gone)), "lines-gone")

    left = docs.withColumns({oid: ident, th: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    joined = left.join(dropped, [oid, th], "left").withColumn(lines, lines_of(F.col(text_col)))  # a column, so that it is split once
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return joined.select(*[F.col(f"`{c}`") if c != text_col else text.alias(c) for c in docs.columns], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.*, coalesce(f.first_id < k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
