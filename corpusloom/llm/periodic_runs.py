"""Runs of words that repeat with a period, by comparing a document's word ids with themselves at every lag.

A run of period q is a stretch in which words q apart are equal, so the comparison at lag q is true throughout it. Every lag up to n / min_exp is
compared, as arrays over many lags at once. As a stretch that counts has at least as many true places as its lag times min_exp - 1 (and as the least length asks for), a
comparison of groups of words at places that far apart meets each of them; where it does, the true stretch around the place is measured word by word. All lags of n words take
about n log n comparisons that way. Documents that need more than ``budget`` of them are dealt to many tasks by ranges of lags.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._text import U, chunks, mix

#: Least words of a run and least periods in it; comparisons of one task's range of lags; comparisons held at once.
MIN_LENGTH, MIN_EXP = 24, 3
BUDGET = 1 << 22
AT_ONCE = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
FACTOR = U(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Run = tuple[int, int, int]


def word_ids(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def groups(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of ``width`` consecutive words, by their first."""
    mixed = mix(ids.astype(U))
    n = len(ids) - width + 1
    out = np.zeros(max(0, n), dtype=U)
    for k in range(width):
        out = out * FACTOR + mixed[k : k + n]
    return out


def true_stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places around ``at`` from which words ``lag`` apart are equal, in pieces of growing size; empty where they differ there."""
    end, piece = at, 64
    while end < len(ids) - lag:
        size = min(piece, len(ids) - lag - end)
        unequal = np.flatnonzero(ids[end : end + size] != ids[end + lag : end + lag + size])
        if len(unequal):
            end += int(unequal[0])
            break
        end, piece = end + size, min(2 * piece, 1 << 16)
    start, piece = at, 64
    while start > 0 and end > at:
        size = min(piece, start)
        unequal = np.flatnonzero(ids[start - size : start] != ids[start - size + lag : start + lag])
        if len(unequal):
            start += int(unequal[-1]) + 1 - size
            break
        start, piece = start - size, min(2 * piece, 1 << 16)
    return start, end


class Lags:
    """Runs of one document whose periods lie in a range of lags."""

    def __init__(self, ids: np.ndarray, min_length: int, min_exp: int):
        self.ids, self.min_length, self.min_exp = ids, min_length, min_exp
        self.width = max(1, (min(self.needed(q) for q in range(1, min_length + 1)) + 1) // 2)
        self.groups = groups(ids, self.width)
        self.regions: dict[int, list[tuple[int, int]]] = {}  # words with a period that no smaller one divides

    def needed(self, lag: int) -> int:
        """True places that a run of this period has at least."""
        return max(self.min_length - lag, (self.min_exp - 1) * lag)

    def hits(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """(lag, places) where groups of words a lag apart are equal, at distances that no stretch of the needed size escapes."""
        size = len(self.groups)
        while low <= high:
            # comparisons grow by the lags taken; the first lag alone may exceed what is held at once
            lags = np.arange(low, min(high, low + AT_ONCE) + 1)
            steps = np.maximum(self.min_length - lags, (self.min_exp - 1) * lags) - self.width + 1
            counts = np.maximum(0, -((lags - size) // steps))
            taken = max(1, int(np.searchsorted(np.cumsum(counts), AT_ONCE, side="right")))
            lags, steps, counts = lags[:taken], steps[:taken], counts[:taken]
            first = np.cumsum(counts) - counts
            places = (np.arange(int(counts.sum())) - np.repeat(first, counts)) * np.repeat(steps, counts)
            equal = np.flatnonzero(self.groups[places] == self.groups[places + np.repeat(lags, counts)])
            if len(equal):
                of = np.searchsorted(first, equal, side="right") - 1
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                for some in np.split(np.arange(len(equal)), cuts):
                    yield int(lags[of[some[0]]]), places[equal[some]]
            low += taken

    def covered(self, at: int, lag: int) -> int | None:
        """The end of the true places, if ``at`` and the word a lag on lie in a region whose period divides the lag: the lag is no smallest period there."""
        divisors = (p for p in self.regions if lag % p == 0) if len(self.regions) < math.isqrt(lag) else (d for k in range(1, math.isqrt(lag) + 1) if lag % k == 0 for d in {k, lag // k} if d in self.regions)
        for period in divisors:
            found = self.regions[period]
            k = bisect_right(found, (at, len(self.ids) + 1)) - 1
            if k >= 0 and found[k][1] > at + lag:
                return found[k][1] - lag
        return None

    def smallest(self, start: int, lag: int) -> int:
        """The smallest period that divides the lag, of the ``lag`` words from ``start`` on, repeated."""
        period, rest, prime = lag, lag, 2
        while rest > 1:
            if prime * prime > rest:
                prime = rest
            while rest % prime == 0:
                rest //= prime
                shorter = period // prime
                if np.array_equal(self.ids[start : start + period - shorter], self.ids[start + shorter : start + period]):
                    period = shorter
            prime += 1
        return period

    def runs(self, low: int, high: int) -> Iterator[Run]:
        for lag, places in self.hits(low, min(high, len(self.ids) // self.min_exp)):
            k = 0
            while k < len(places):
                at = int(places[k])
                end = self.covered(at, lag)
                if end is None:
                    start, end = true_stretch(self.ids, at, lag)
                    if end - start >= self.needed(lag):
                        period = self.smallest(start, lag)
                        insort(self.regions.setdefault(period, []), (start, end + lag))
                        if period == lag:
                            yield start, end - start + lag, lag
                k = max(k + 1, int(np.searchsorted(places, end)))


def runs_of(words: list[str], low: int = 1, high: int | None = None, min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP) -> list[Run]:
    """(start, length, period) of the runs with periods in the range, by start and period."""
    return sorted(Lags(word_ids(words), min_length, min_exp).runs(low, len(words) if high is None else high), key=lambda r: (r[0], r[2])) if len(words) >= min_length else []


def collapsed(words: list[str], runs: Iterable[Run]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    if not change.any():
        return " ".join(words)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def rows_of(part: pa.RecordBatch, runs: list[list[Run]], words: list[list[str]]) -> pa.RecordBatch:
    lists = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs]
    texts = [collapsed(w, x) for w, x in zip(words, runs, strict=True)]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(lists, RUN), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def all_lags(min_length: int, min_exp: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [WORDS.findall(t or "") for t in part.column(1).to_pylist()]
                yield rows_of(part, [runs_of(w, min_length=min_length, min_exp=min_exp) for w in words], words)

    return run


def some_lags(min_length: int, min_exp: int):
    """(text_key, text, low, high) to the runs whose periods lie in the range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for key, text, low, high in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    found = runs_of(WORDS.findall(text), low, high, min_length, min_exp)
                    columns = list(zip(*found, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string())] + [pa.array(c, pa.int64()) for c in columns], names=["text_key", "start", "length", "period"])

    return run


def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) to the operator's rows."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words = [WORDS.findall(t) for t in part.column(1).to_pylist()]
            runs = [sorted(((r["start"], r["length"], r["period"]) for r in x or ()), key=lambda r: (r[0], r[2])) for x in part.column(2).to_pylist()]
            yield rows_of(part, runs, words)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` are all stretches of at least ``min_length`` words and ``min_exp`` (2 or more) periods that no neighbouring word extends, as (start, length, period) with
    their smallest period, by start and period; runs of different periods may overlap. ``collapsed`` is the text without what repeats: words that a run contains after
    its first period go, the others are joined by one space. Null, empty and white texts have no words. Rows without an id and repeated rows are taken
    each; other columns are not read. A text whose lags need more than about ``budget`` comparisons is compared in several tasks, once for all its copies.
    """
    if min_exp < 2 or min_length < 1:
        raise ValueError("a run has at least two periods and one word")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = "doc_id long, n_words long, runs " + RUNS + ", collapsed string"
    most = (F.length("text") + 1) / 2  # words
    work = most * (1 + F.log(F.greatest(most / min_length, F.lit(1.0))) / 2)
    short = rows.filter(work <= budget).mapInArrow(all_lags(min_length, min_exp), out)
    long = rows.filter(work > budget).withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    # ranges whose lags grow by one factor take like many comparisons
    ranges = long.select("text_key", "text", F.ceil(work / budget).cast("int").alias("parts"), F.ceil(most / min_exp).alias("lags")).dropDuplicates(["text_key"])
    bound = lambda j: F.floor(F.pow(F.col("lags"), j / F.col("parts")))
    ranges = ranges.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("j"))
    ranges = ranges.select("text_key", "text", F.when(F.col("j") == 1, 1).otherwise(bound(F.col("j") - 1) + 1).cast("long").alias("low"), F.when(F.col("j") == F.col("parts"), F.col("lags")).otherwise(bound(F.col("j"))).cast("long").alias("high"))
    found = ranges.repartition("text_key", "low").mapInArrow(some_lags(min_length, min_exp), "text_key string, start long, length long, period long")
    found = found.groupBy("text_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionByName(long.join(found, "text_key", "left").select("doc_id", "text", "runs").mapInArrow(put_together, out))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in each document whose CRC-32 of the decimal id is a multiple of 10: as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))
    rows = rows.select("*", F.when(F.col("w").isNotNull(), F.size("w")).alias("n"))
    rows = rows.select("*", (F.col("g") % F.nullif(F.col("n"), F.lit(0))).cast("int").alias("a"))
    rest = F.col("n") - F.col("a")
    rows = rows.select("*", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("n") > 0, F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a")), tail))).otherwise(F.col("text"))
    # a generator's column: a filter on it cannot be moved below it, where the words would be taken from the text once for each mention
    return rows.select("doc_id", F.explode(F.array(text)).alias("text"))


def most_periods(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equal ones; null without runs."""
    return F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most_periods(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
