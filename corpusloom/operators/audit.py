"""Preservation of equations between a source and a copy, with cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex


def canonical_sets(docs: DataFrame, key: str, tex: str) -> DataFrame:
    """(key, form): distinct canonical forms of each document's equations."""
    eqs = docs.select(key, F.explode(latex.equations_of(tex)).alias("eq"))
    return eqs.select(key, latex.canonical_key(latex.canonical_of("eq")).alias("form")).distinct()


def compare(source: DataFrame, copy: DataFrame, key: str, form: str = "form") -> DataFrame:
    """(key, n_source, n_copy, preserved, absent, discordant) of each document of the source, from its forms; repeated and null ones do not count.

    absent is max(0, source - copy), discordant max(0, min(source, copy) - preserved). Both sets are dealt by document once, ROWS
    rows a task or fewer, and counted where they lie: a task holds its own forms, not a share that grows with the table.
    """
    marks = lambda df, s: df.select(key, form, F.lit(s).alias("s"), F.lit(not s).alias("c")).where(F.col(form).isNotNull())
    both = marks(source, True).unionByName(marks(copy, False))
    tasks = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // ROWS))
    forms = both.repartition(tasks, key).groupBy(key, form).agg(F.max("s").alias("s"), F.max("c").alias("c"))
    out = forms.groupBy(key).agg(F.count_if("s").alias("n_source"), F.count_if("c").alias("n_copy"), F.count_if(F.col("s") & F.col("c") & F.col(key).isNotNull()).alias("preserved"))
    return out.where("n_source > 0").withColumns({
        "absent": F.greatest(F.lit(0).cast("long"), F.col("n_source") - F.col("n_copy")),
        "discordant": F.greatest(F.lit(0).cast("long"), F.least("n_source", "n_copy") - F.col("preserved")),
    })


def audit_summary(compared: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c)
    rate = lambda c: F.round(s(c) / s("n_source"), 6)
    return compared.agg(F.count("*").alias("documents"), s("n_source").alias("equations"), rate("preserved").alias("preserved_rate"), rate("absent").alias("absent_rate"), rate("discordant").alias("discordant_rate"))


#: Rows of both sets in a task of ``compare``, on average at most.
ROWS = 1_000_000
#: Documents of a task, about, where there are enough for all cores: enough to hide what a call of NumPy costs. No array is longer.
STEP = 1 << 16
SHIFTS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_bits(words: list[list]) -> np.ndarray:
    """The first 32 bits of the MD5 of many messages of one length: of each 64-byte block its 16 words, each an array or what all messages share."""
    size = next((len(w) for block in words for w in block if isinstance(w, np.ndarray)), 1)
    left, right = np.empty(size, np.uint32), np.empty(size, np.uint32)
    state = [np.full(size, x, np.uint32) for x in START]
    for last, block in enumerate(words, 1 - len(words)):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64 if last else 61):  # the last three steps give the other bits
            if i < 16:
                np.bitwise_xor(c, d, out=left)
                left &= b
                left ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=left)
                left &= d
                left ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=left)
                left ^= d
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=left)
                left |= b
                left ^= c
                g = 7 * i % 16
            a += left
            if isinstance(block[g], np.ndarray):
                a += block[g]
                a += np.uint32(SINES[i])
            else:
                a += np.uint32((SINES[i] + block[g]) % 2**32)
            np.right_shift(a, np.uint32(32 - SHIFTS[i]), out=right)
            a <<= np.uint32(SHIFTS[i])
            a |= right
            a += b
            a, b, c, d = d, a, b, c
        if last:
            state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return (state[0] + b).byteswap()  # the first step of a round gives what is three steps old here


def draws(seed: int, keys: np.ndarray, resamples: int) -> Iterator[tuple[int, np.ndarray]]:
    """(b, u) for b from 1: the first 32 bits of the MD5 of ``seed|b|key`` for keys of one length, a row of bytes each.

    Resamples whose numbers have the same length differ in few words of the message, which are single numbers.
    """
    n, length = keys.shape
    for digits in range(1, len(str(resamples)) + 1):
        head = len(f"{seed}|") + digits + 1
        blocks = (head + length + 8) // 64 + 1
        message = np.zeros((n, blocks * 64), np.uint8)
        message[:, head - 1] = ord("|")
        message[:, head : head + length] = keys
        message[:, head + length] = 0x80
        message[:, -8:] = np.frombuffer((8 * (head + length)).to_bytes(8, "little"), np.uint8)
        rest = np.ascontiguousarray(message.view("<u4").T)
        rest = [row if (row != row[0]).any() else int(row[0]) for row in rest]
        for b in range(10 ** (digits - 1), min(10**digits, resamples + 1)):
            lead = f"{seed}|{b}".encode()
            lead = np.frombuffer(lead + bytes(-len(lead) % 4), "<u4").tolist()
            words = [row + np.uint32(w) if isinstance(row, np.ndarray) else row + w for row, w in zip(rest, lead, strict=False)] + rest[len(lead) :]
            yield b, first_bits([words[k : k + 16] for k in range(0, len(words), 16)])


def weighted_sums(resamples: int, seed: int):
    """Rows (key, part, whole) to (b, p, q): the sums of both with Poisson weights."""
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        steps.append(np.uint32(math.ceil(total * 2**32)))
        term /= k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None

        def add(rows: pa.Table) -> None:
            keys = rows.column(0).cast(pa.large_binary()).combine_chunks()
            ends, data = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1], np.frombuffer(keys.buffers()[2] or b"", np.uint8)
            at, sizes = ends[:-1], np.diff(ends)
            values = np.stack([np.asarray(c.combine_chunks().fill_null(0)) for c in rows.columns[1:]])
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                for some in np.array_split(same, -(-len(same) // STEP)):  # what a core's share of the cache holds
                    of = values[:, some]
                    for b, u in draws(seed, data[at[some][:, None] + np.arange(size)], resamples):
                        weight = np.zeros(len(some), np.uint8)
                        for x in steps:
                            weight += u >= x
                        sums[:, b - 1] += of @ weight.astype(of.dtype)

        held, n = [], 0
        for batch in batches:
            if sums is None:
                sums = np.zeros((2, resamples), np.asarray(batch.column(1).slice(0, 0)).dtype)
            for i in range(0, batch.num_rows, STEP):
                held.append(batch.slice(i, STEP))
                n += held[-1].num_rows
                if n >= 2 * STEP:
                    add(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            add(pa.Table.from_batches(held))
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1)), pa.array(sums[0]), pa.array(sums[1])], names=["b", "p", "q"])

    return run


def bootstrap_ratio(rows: DataFrame, key: str, part: str, whole: str, resamples: int = 1000, seed: int = 17, least: int = 30) -> DataFrame:
    """(documents, lo, hi): 95 % interval of sum(part) / sum(whole), drawing documents.

    Each document's weight in each resample is Poisson(1), drawn from a hash of (seed, resample, key), so documents
    never meet in one task and the result can be repeated. Tasks hash their documents together in arrays and give one row
    a resample. A document without a key counts, but is not drawn. Null bounds below ``least`` documents.
    """
    context = rows.sparkSession.sparkContext
    whole_numbers = {"tinyint", "smallint", "int", "bigint"}
    kind = "long" if {dict(rows.dtypes)[c] for c in (part, whole)} <= whole_numbers else "double"
    count = rows.count()
    cores = context.defaultParallelism
    tasks = max(1, min(cores * max(1, round(count / cores / STEP)), count // 1024))
    dealt = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(part).cast(kind).alias("p"), F.col(whole).cast(kind).alias("q"))
    dealt = dealt.repartitionByRange(tasks, F.octet_length("key"), F.monotonically_increasing_id())  # keys of one length are hashed together
    sums = dealt.mapInArrow(weighted_sums(resamples, seed), f"b long, p {kind}, q {kind}").groupBy("b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rates = sums.select(F.when(F.col("q") > 0, F.col("p") / F.col("q")).otherwise(0.0).alias("r"))
    bounds = rates.agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))
    n = F.lit(count).cast("long")
    return bounds.select(n.alias("documents"), *[F.when(n >= least, F.round(c, 6)).alias(c) for c in ("lo", "hi")])
