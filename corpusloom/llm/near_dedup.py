"""Near-duplicates by min-max hashing.

Each permutation is evaluated once per shingle and gives two signature values, its minimum and its
maximum; bands of the values bring similar documents together. Copies with the same shingle set
are one class from the start, and only its smallest document is compared. In each band bucket documents are compared
with one pivot, the member that most others meet, and not with each other. Members of buckets that are then still in different
components are joined on the rarest shingles of their whole sets (an exact prefix filter), so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, read_table, shuffle_parts, stored
from ._text import SPACE, U, chunks, mix, words
from .components import connected_components

SHINGLE = 5
#: 80 permutations give 160 values, 32 bands of 5: a pair of similarity 0.85 meets in no band once in 10**8.
BANDS, ROWS = 32, 5
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 2**63, BANDS * ROWS // 2, dtype=np.int64).astype(U) * U(2) + U(1)
ADDENDS = _rng.integers(0, 2**63, BANDS * ROWS // 2, dtype=np.int64).astype(U)
PLACES = _rng.integers(0, 2**63, SHINGLE + BANDS * ROWS + 1, dtype=np.int64).astype(U) * U(2) + U(1)
#: Counters of shingles for the order of the prefix filter, at most; sizes of sets whose ratio is below this share a class.
COUNTERS, SIZE_STEP = 1 << 20, 1.04
#: Pairs of one pivot that a task takes together: a share of a task's mean, and at least so many, as each group reads the pivot's text.
SALT_SHARE, SALT_ROWS = 0.5, 16

_BLOCK = 2048


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the shingles of some texts, one after another, and the bounds of each text's.

    A text of 1 to 4 words is one shingle; a text without words has none. Fingerprints repeat as shingles do.
    """
    found = words(texts, SPACE)
    h, counts = found.hashes(), np.diff(found.bounds)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    first = found.bounds[:-1][text_of] + np.arange(bounds[-1]) - bounds[text_of]
    left = found.bounds[1:][text_of] - first
    out = np.minimum(left, SHINGLE).astype(U) * U(0xA24BAED4963EE407)
    for k in range(SHINGLE):
        ok = left > k
        out += np.where(ok, h[np.minimum(first + k, len(h) - 1)] * PLACES[k] if len(h) else U(0), U(0))
    return mix(out), bounds


def unique_sets(texts: pa.Array) -> list[np.ndarray]:
    values, bounds = shingle_sets(texts)
    return [np.unique(values[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each set under each permutation: (sets, 2 * permutations). Sets must not be empty."""
    n, k = len(bounds) - 1, len(MULTIPLIERS)
    low, high = np.full((n, k), np.iinfo(U).max, dtype=U), np.zeros((n, k), dtype=U)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(0, len(values), _BLOCK):
        own = owner[i : i + _BLOCK]
        hashed = values[i : i + _BLOCK, None] * MULTIPLIERS + ADDENDS
        cuts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        who = own[cuts]
        low[who] = np.minimum(low[who], np.minimum.reduceat(hashed, cuts, axis=0))
        high[who] = np.maximum(high[who], np.maximum.reduceat(hashed, cuts, axis=0))
    return np.concatenate([low, high], axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; the band is part of the key."""
    out = np.empty((len(signature), BANDS), dtype=U)
    for b in range(BANDS):
        total = np.full(len(signature), b, dtype=U) * U(0x9FB21C651E98DF25)
        for r in range(ROWS):
            at = b * ROWS + r
            total += mix(signature[:, at]) * PLACES[SHINGLE + at]
        out[:, b] = mix(total)
    return out


SKETCH = "oid long, n long, d1 long, d2 long, bands array<long>"


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = unique_sets(part.column(1))
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
            full = np.flatnonzero(np.diff(bounds))
            ends = np.concatenate([[0], bounds[1:][full]])
            keys = band_keys(signatures(values, ends)) if len(full) else np.zeros((0, BANDS), dtype=U)
            digests = np.zeros((2, len(sets)), dtype=U)
            for row, salt in enumerate((0x51ED270B35AE3C57, 0x2545F4914F6CDD1D)):
                sums = np.concatenate([[U(0)], np.cumsum(mix(values ^ U(salt)), dtype=U)])
                digests[row] = mix(sums[bounds[1:]] - sums[bounds[:-1]])
            at = np.zeros(len(sets) + 1, dtype=np.int32)
            at[1:][full] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(keys.view(np.int64).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), bands], names=["oid", "n", "d1", "d2", "bands"])


def compare(percent: int):
    """Of rows (pivot, salt, is_pivot, oid, text) sorted so, the pairs (a, b) with 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part in chunks(batch, "text"):
                pivots, salts, kinds, oids = (part.column(i).to_pylist() for i in range(4))
                a, b = [], []
                for key, kind, oid, own in zip(zip(pivots, salts, strict=True), kinds, oids, unique_sets(part.column(4)), strict=True):
                    if key != now:
                        now, held = key, []
                    if kind == 0:
                        held.append(own)
                        continue
                    for other in held:
                        if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                            continue
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(other) - common):
                            a.append(oid)
                            b.append(key[0])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (oid, pivot) that are links, as (a, b); texts is (oid, text).

    A pivot's pairs are dealt to as many groups as they fill with SALT_SHARE of a task's mean; each group gets the pivot's text.
    """
    parts = shuffle_parts(pairs.sparkSession)
    pairs = pairs.withColumn("salt", F.lit(0))
    rows = max(SALT_ROWS, int(pairs.count() * SALT_SHARE / parts))
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / rows).cast("int").alias("salts"))
    big = scratch.stored(many.where("salts > 1"), "salts")
    pairs = pairs.join(big.hint("merge"), "pivot", "left")
    members = pairs.select("oid", "pivot", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("oid"), F.col("salts")).cast("int")).otherwise(0).alias("salt"), F.lit(1).alias("kind"))
    heads = many.select(F.col("pivot").alias("oid"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    wanted = scratch.stored(members.unionByName(heads), "wanted")
    rows = texts.join(wanted.hint("merge"), "oid").select("pivot", "salt", "kind", "oid", "text")
    rows = rows.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return rows.mapInArrow(compare(percent), "a long, b long").distinct()


def shingle_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, n): how many of the sets have a shingle of each counter."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            for own in unique_sets(part.column(2)):
                np.add.at(total, (own & U(COUNTERS - 1)).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bin", "n"])


PREFIX = "token long, step int, small boolean, oid long, label long, n long, pos long"


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP) + 1e-9).astype(np.int64)


def prefixes(shared, percent: int):
    """Rows of the shingles, rarest first, at which a set may first meet a set it is linked with.

    Two linked sets share so many shingles that the first common one stands early in both. A set is listed under its own size
    class for partners at least as large (``small``), and under the size classes of those smaller partners that a place allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                cols: list[list[np.ndarray]] = [[] for _ in range(7)]

                def put(tokens, steps, small, oid, label, n, pos, cols=cols):
                    for c, x in zip(cols, (tokens.view(np.int64), steps, np.full(len(tokens), small), np.full(len(tokens), oid), np.full(len(tokens), label), np.full(len(tokens), n), pos), strict=True):
                        c.append(x)

                for oid, label, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), unique_sets(part.column(2)), strict=True):
                    n = len(own)
                    order = np.lexsort((own, counters[(own & U(COUNTERS - 1)).astype(np.int64)]))
                    pos = np.arange(n)
                    near = pos[(100 + percent) * (n - pos) >= 2 * percent * n]
                    put(own[order[near]], np.full(len(near), size_class(np.array([n]))[0]), True, oid, label, n, near)
                    least = -(-percent * n // 100)
                    most = np.minimum(n, (100 + percent) * (n - pos) // percent - n)
                    far = pos[most >= least]
                    low, high = size_class(np.array([least]))[0], size_class(most[far])
                    times = high - low + 1
                    steps = np.repeat(low, times.sum()) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    put(np.repeat(own[order[far]], times), steps, False, oid, label, n, np.repeat(far, times))
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "step", "small", "oid", "label", "n", "pos"])

    return run


def prefix_pairs(texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(oid, pivot) of all texts (oid, label, text) of different labels that may be linked."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(shingle_counters, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counters = np.zeros(COUNTERS, dtype=np.int32)
    counters[np.asarray(counted.column("bin"))] = np.minimum(np.asarray(counted.column("n")), 2**31 - 1)
    rows = scratch.stored(texts.mapInArrow(prefixes(spark.sparkContext.broadcast(counters), percent), PREFIX), "prefixes")
    a = rows.where("small").select("token", "step", F.col("oid").alias("oa"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = rows.where("not small").select("token", "step", F.col("oid").alias("ob"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    c = F.col
    same = (a["token"] == b["token"]) & (a["step"] == b["step"]) & (c("la") != c("lb")) & ((c("na") < c("nb")) | ((c("na") == c("nb")) & (c("oa") < c("ob"))))
    enough = (100 + percent) * F.least(c("na") - c("pa"), c("nb") - c("pb")) >= percent * (c("na") + c("nb"))
    return a.hint("merge").join(b, same & enough).select(c("ob").alias("oid"), c("oa").alias("pivot")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| of their sets of 5-word shingles (words
    between ASCII white space, A-Z in lower case); component_id is the smallest id reachable. Null and
    empty texts have no shingles and no links. Rows that share an id are one document that is linked by
    any of its texts, and each row is returned. Rows without an id have no links, no component and are kept. Only the id and the
    text are read, so other columns do not matter. An empty table gives an empty table.
    """
    with Scratch(docs.sparkSession) as scratch:
        return stored(_components(docs, percent, id_col, text_col, scratch), "near-duplicates")


def _components(docs: DataFrame, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("oid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = scratch.stored(texts.mapInArrow(sketch, SKETCH), "sketch")

    # classes of equal sets
    usable = table.where("oid is not null and n > 0")
    classes = usable.groupBy("n", "d1", "d2").agg(F.min("oid").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    classes = scratch.stored(classes, "classes")
    member = usable.select("oid", "n", "d1", "d2").join(classes.hint("merge"), ["n", "d1", "d2"]).select("oid", "rep").where("oid <> rep").distinct()
    member = scratch.stored(member, "members")
    alone = usable.join(classes.hint("merge"), ["n", "d1", "d2"], "left").where("rep is null or rep = oid")

    buckets = alone.select("oid", F.explode("bands").alias("key")).distinct()
    counts = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    counts = scratch.stored(counts, "bucket-sizes")
    buckets = scratch.stored(buckets.join(counts.hint("merge"), "key"), "buckets")

    # an id may stand for several sets (rows that share it): its first label is the smallest of their classes
    labels = usable.select("oid").distinct().select(F.col("oid").alias("v"), F.col("oid").alias("label"))
    edges = [member.select(F.col("oid").alias("a"), F.col("rep").alias("b"))]
    if not buckets.isEmpty():
        some = scratch.stored(texts.join(buckets.select("oid").distinct().hint("merge"), "oid", "left_semi"), "bucket-texts")
        popular = buckets.groupBy("oid").agg(F.sum("size").alias("popular"))
        ranked = buckets.select("oid", "key").join(popular, "oid")
        heads = ranked.groupBy("key").agg(F.max(F.struct("popular", (-F.col("oid")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("pivot"))
        pairs = buckets.select("oid", "key").join(scratch.stored(heads, "pivots").hint("merge"), "key").where("oid <> pivot").select("oid", "pivot").distinct()
        pairs = scratch.stored(pairs, "pairs")
        edges.append(scratch.stored(verified(pairs, some, percent, scratch), "links"))
        links = edges[0].unionByName(edges[1])
        labels = connected_components(labels, links, scratch)
        state = scratch.stored(buckets.select("oid", "key").join(labels.select(F.col("v").alias("oid"), "label"), "oid"), "states")
        mixed = state.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key")
        mixed = scratch.stored(mixed, "open-keys")
        if not mixed.isEmpty():
            waiting = state.join(mixed.hint("merge"), "key", "left_semi").select("oid", "label").distinct()
            open_texts = scratch.stored(waiting.join(some, "oid"), "open-texts")
            pairs = scratch.stored(prefix_pairs(open_texts, percent, scratch), "pairs")
            if not pairs.isEmpty():
                more = scratch.stored(verified(pairs, open_texts.select("oid", "text"), percent, scratch), "links")
                labels = connected_components(labels, links.unionByName(more), scratch)
    else:
        labels = connected_components(labels, edges[0], scratch)

    out = table.select("oid", "n").join(labels.select(F.col("v").alias("oid"), "label"), "oid", "left")
    component = F.coalesce(F.col("label"), F.col("oid"))
    return out.select(F.col("oid").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("oid").isNull() | (F.col("oid") == component)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest id; of rows that share an id all stay."""
    gone = near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: For fixtures only; on whole tables the self-join of all shingles is too slow.
BRUTE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
"""
