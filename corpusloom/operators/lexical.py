"""Ranked text search over an inverted index, and the fusion of ranked lists.

The index holds each term's documents in blocks of about BLOCK documents, with what bounds the weights in the block (its most occurrences and its shortest document); a frequent
term has many blocks, so no task and no group holds all of its documents. One pass over the texts writes it. A block's terms lie in one bucket of the table: the queries are sent to the blocks, which are not shuffled again and give only their k best documents of a query. A search first takes a lower bound of each query's k-th score from its rarest terms, then the terms that a document of that score must
have, then the blocks whose bounds reach it, and scores the documents of those blocks in full. What is skipped is below the bound: results are exact.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import Tables, stored

#: Okapi parameters; parts of a score are whole numbers of 1 / UNIT, so that sums do not depend on their order.
K1, B = 1.2, 0.75
UNIT = 1_000_000
#: Documents in a block, on average: what queries send grows with the blocks, and small ones are hardly ever skipped; documents that a query's first bound is taken from, of one term.
BLOCK, FIRST = 1024, 4096
#: Buckets of an index at most; query terms that are broadcast at most.
MOST_BUCKETS, FEW_TERMS = 20_000, 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """Words of ASCII letters and digits and all characters beyond ASCII, with A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0), F.array().cast("array<string>"))


SCHEMA = "block int, term string, n long, most int, least int, docs array<long>, counts array<int>"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
WORDS = re.compile(WORD)


@dataclass
class Index:
    """``blocks``: (block, term, n, most, least, docs, counts), bucketed by block; the row without a term has all documents of the block and their words.

    ``documents``: all that were indexed, with or without words; ``average``: their words.
    """

    blocks: DataFrame
    documents: int
    average: float
    n_blocks: int
    table: str

    def drop(self) -> None:
        """Forget the table's name; the files below its path stay."""
        self.blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def indexed(rows: pa.Table) -> pa.Table:
    """The rows (block, doc, text) of one block to its terms' documents."""
    ids, local = np.unique(np.asarray(rows.column("doc")), return_inverse=True)
    known: dict[str, int] = {}
    codes, sizes = [], []
    for text in rows.column("text").to_pylist():
        words = WORDS.findall((text or "").translate(ASCII_LOWER))
        codes += [known.setdefault(w, len(known)) for w in words]
        sizes.append(len(words))
    at = np.repeat(local, sizes)
    lengths = np.bincount(at, minlength=len(ids))
    pairs, counts = np.unique(np.array(codes, dtype=np.int64) * len(ids) + at, return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    starts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else np.zeros(1, dtype=np.int64)
    most = np.maximum.reduceat(counts, starts[:-1]) if len(term) else starts[:0]
    least = np.minimum.reduceat(lengths[doc], starts[:-1]) if len(term) else starts[:0]
    n = len(starts) - 1
    block = rows.column("block")[0].as_py()
    return pa.table({
        "block": pa.array(np.full(n + 1, block), pa.int32()),
        "term": pa.array([*known, None], pa.string()),  # in the order of their codes
        "n": pa.array(np.append(np.diff(starts), len(ids)), pa.int64()),
        "most": pa.array(np.append(most, 0), pa.int32()),
        "least": pa.array(np.append(least, 0), pa.int32()),
        "docs": pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1] + len(ids)), pa.int32()), pa.array(np.append(ids[doc], ids), pa.int64())),
        "counts": pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1] + len(ids)), pa.int32()), pa.array(np.append(counts, lengths), pa.int32())),
    })


def inverted_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> Index:
    """Write the index of ``docs`` below ``path``.

    Rows of one key are one document, whose words are counted together; rows without a key are left out; documents without words count
    in the number of documents. One shuffle deals the documents to blocks, whose terms are counted where they lie.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    n_blocks = max(1, -(-rows.select("doc").distinct().count() // block))
    buckets = max(1, min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS))
    at = F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = rows.select(at, "doc", "text").repartition(buckets, "block").groupBy("block").applyInArrow(indexed, SCHEMA)
    name = f"index_{uuid.uuid4().hex}"
    blocks.write.option("compression", "zstd").bucketBy(buckets, "block").option("path", f"{path}/blocks").format("parquet").saveAsTable(name)
    whole = spark.table(name).where("term IS NULL").agg(F.sum("n").alias("documents"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"))
    known = whole.select(F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("words", F.lit(0)).alias("words"), F.lit(n_blocks).cast("long").alias("n_blocks"), F.lit(buckets).cast("long").alias("buckets"))
    known.coalesce(1).write.parquet(f"{path}/statistics")
    spark.sql(f"DROP TABLE {name}")  # the name; the files stay
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index below ``path`` under a name of this session's catalog."""
    known = spark.read.parquet(f"{path}/statistics").first()
    table = f"index_{uuid.uuid4().hex}"
    columns = ", ".join(SCHEMA.split(", "))
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (block) INTO {known.buckets} BUCKETS LOCATION '{path}/blocks'")
    return Index(spark.table(table), known.documents, (known.words / known.documents if known.documents else 0.0) or 1.0, known.n_blocks, table)


def weight(tf, length, average: float):
    """What a term of ``tf`` occurrences gives a document, its rarity aside; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def rarity(documents: Column, holding: Column) -> Column:
    return F.round(F.log(1 + (documents - holding + 0.5) / (holding + 0.5)), 9)


def bound_of(average: float) -> Column:
    """What a term can give a document of a block, at most; one more for what rounding may do."""
    return 1 + F.floor(F.lit(float(UNIT)) * (F.col("idf") * weight(F.col("most").cast("double"), F.col("least").cast("double"), average)))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best of each query, ties by the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def scored(k: int, average: float):
    """A block's terms and the terms that queries send to it, to the k best documents of each query in the block."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not block.num_rows or not asked.num_rows:
            return none
        block = block.combine_chunks()
        docs, counts = block.column("docs").combine_chunks(), block.column("counts").combine_chunks()
        offsets = np.asarray(docs.offsets)
        at = {t: i for i, t in enumerate(block.column("term").to_pylist())}
        all_of = slice(offsets[at[None]], offsets[at[None] + 1])
        values, tf = np.asarray(docs.values), np.asarray(counts.values)
        ids, lengths = values[all_of], tf[all_of]  # by id
        local = np.searchsorted(ids, values)
        parts = weight(tf.astype(np.float64), lengths[local].astype(np.float64), average)
        terms = asked.column("term").combine_chunks().dictionary_encode()
        rows = np.array([at.get(t, -1) for t in terms.dictionary.to_pylist()])[np.asarray(terms.indices)]
        queries, idf = np.asarray(asked.column("query")), np.asarray(asked.column("idf"))
        keep = rows >= 0
        rows, queries, idf = rows[keep], queries[keep], idf[keep]
        order = np.argsort(queries, kind="stable")
        rows, queries, idf = rows[order], queries[order], idf[order]
        cuts = np.append(0, np.flatnonzero(queries[1:] != queries[:-1]) + 1) if len(rows) else np.zeros(0, dtype=np.int64)
        out = []
        for low, high in zip(cuts, np.append(cuts[1:], len(rows))):
            some = rows[low:high]
            sizes = offsets[some + 1] - offsets[some]
            where = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[some], sizes)
            impacts = np.floor(float(UNIT) * (np.repeat(idf[low:high], sizes) * parts[where]))
            totals = np.bincount(local[where], weights=impacts, minlength=len(ids)).astype(np.int64)  # whole numbers: exact
            held = np.unique(local[where])
            best_of = held[np.lexsort((ids[held], -totals[held]))[:k]]
            out.append((np.full(len(best_of), queries[low]), ids[best_of], totals[best_of]))
        return pa.table(dict(zip(("query", "doc", "score"), map(np.concatenate, zip(*out)), strict=True))) if out else none

    return run


def sums(terms: DataFrame, blocks: DataFrame, k: int, average: float) -> DataFrame:
    """(query, doc, score): the k best documents by the sums over ``terms`` (block, query, term, idf) in each block that a query names."""
    return blocks.select("block", "term", "docs", "counts").groupBy("block").cogroup(terms.select("block", "query", "term", "idf").groupBy("block")).applyInArrow(scored(k, average), "query long, doc long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", first: int = FIRST) -> DataFrame:
    """(query, doc, score, rank): the k documents of the largest BM25 score, in millionths, of each query; only documents that share a word with it.

    A query is the set of its words; rows of one key are one query, rows without a key or words give nothing. Ties go to the smaller document id.
    """
    spark = queries.sparkSession
    blocks = index.blocks
    words = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query"), F.explode(terms_of(F.col(text))).alias("term")).distinct()
    with Tables(spark) as tables:
        words = tables.stored(words, "query-terms")
        used = words.select("term").distinct()
        if used.count() <= FEW_TERMS:  # small enough to be sent to all tasks: the other terms are not read any further
            listed = F.broadcast(used.unionByName(spark.createDataFrame([(None,)], "term string"))).alias("u")  # and the row without a term
            blocks = blocks.alias("b").join(listed, F.col("b.term").eqNullSafe(F.col("u.term")), "left_semi")
        tops = tables.stored(blocks.select("block", "term", "n", "most", "least").join(used, "term", "left_semi"), "block-bounds")
        by_term = tops.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))
        terms = words.join(by_term, "term").withColumn("idf", rarity(F.lit(float(index.documents)), F.col("df"))).withColumn("most", bound_of(index.average))
        terms = tables.stored(terms.select("query", "term", "df", "idf", "most"), "weighed-terms")

        # a first bound: sums over the rarest terms, of frequent ones over some of their blocks, are at most the scores
        before = F.sum("df").over(Window.partitionBy("query").orderBy("df", "term")) - F.col("df")
        rarest = terms.withColumn("before", before).where(F.col("before") < 4 * k).select("query", "term", "idf", F.ceil(F.lit(float(index.n_blocks) * first) / F.col("df")).alias("upto"))
        some = rarest.join(tops.select("block", "term"), "term").where(F.col("block") < F.col("upto"))
        bound = best(sums(some, blocks, k, index.average), k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("bound"))
        bound = tables.stored(bound, "bounds")

        # terms of small weight, which together stay below the bound: a document with these alone is no result
        weakest = Window.partitionBy("query").orderBy("most", "term")
        split = terms.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("sum", F.sum("most").over(weakest))
        split = split.withColumn("weak", F.col("sum") < F.col("bound"))
        rest = split.groupBy("query", "bound").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0)).alias("rest"))
        reach = split.where("NOT weak").select("query", "term", "idf").join(tops, "term").select("query", "block", bound_of(index.average).alias("i"))
        reach = reach.groupBy("query", "block").agg(F.sum("i").alias("reach")).join(rest, "query").where("reach + rest >= bound").select("query", "block")
        wanted = reach.join(terms.select("query", "term", "idf"), "query")
        return tables.kept(best(sums(wanted, blocks, k, index.average), k), "search")


def ranked(scored: DataFrame, query: str, candidate: str, score: str, depth: int) -> DataFrame:
    """(query, candidate, rank) of one list: equal scores share the smallest rank, ranks beyond ``depth`` are cut."""
    rank = F.rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    rows = scored.where(F.col(query).isNotNull() & F.col(candidate).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(query).alias("query"), F.col(candidate).alias("candidate")).agg(F.max(score).alias("score"))
    return rows.select("query", "candidate", rank.alias("rank")).where(F.col("rank") <= depth)


def fused(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(query, candidate, score, rank_0, rank_1, ...): reciprocal rank fusion, the sum of weight / (k + rank) over the lists that hold the candidate.

    ``lists`` are (query, candidate, rank), each cut where it likes; a candidate that a list does not hold has no rank there and gets nothing from it. One
    shuffle merges all lists: they are stacked and grouped, not joined. Of a pair that a list holds more than once, the best rank counts.
    """
    weights = weights or [1.0] * len(lists)
    names = [f"rank_{i}" for i in range(len(lists))]
    rows = None
    for i, part in enumerate(lists):
        part = part.select("query", "candidate", *[(F.col("rank") if j == i else F.lit(None)).cast("long").alias(n) for j, n in enumerate(names)])
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("query", "candidate").agg(*[F.min(n).alias(n) for n in names])
    score = F.lit(0.0)
    for n, w in zip(names, weights, strict=True):  # always in this order, so that ties are ties
        score = score + F.coalesce(F.lit(float(w)) / (k + F.col(n)), F.lit(0.0))
    return merged.select("query", "candidate", score.alias("score"), *names)


def fused_top(lists: list[DataFrame], depth: int, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """``fused`` with the final rank, cut at ``depth``; ties go to the candidate with the better rank in the first list, then in the next ones, then the smaller id."""
    names = [f"rank_{i}" for i in range(len(lists))]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), *[F.col(n).asc_nulls_last() for n in names], "candidate"))
    return fused(lists, k, weights).withColumn("rank", rank).where(F.col("rank") <= depth)
