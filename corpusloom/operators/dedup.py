"""Exact and signature duplicates, clusters and representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import licensing
from ..functions.text import exact_key, normal_form
from ._tables import stored

#: Signature length, seed, bands and rows; the modulus keeps products below 2**62.
N_PERM, SEED, BANDS, ROWS, MODULUS = 128, 17, 16, 8, 2**31 - 1
SHINGLE = 5
#: Buckets of more members are reported as crowded.
MOST = 500
#: Members of a bucket that are dealt to one group, about.
BLOCK = 512
#: Rows that a task gives back at once: signatures, and pairs.
OUT_ROWS, OUT_PAIRS = 1_000, 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores; unchanged, without a shuffle, for larger inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def exact_groups(df: DataFrame, key: str, text: str, unicode: bool = True) -> DataFrame:
    """(key, first_id, copies): each row's exact group by its smallest id; hot groups are summed before the shuffle."""
    keyed = spread(df.select(key, text)).select(key, exact_key(F.coalesce(text, F.lit("")), unicode).alias("__k"))
    groups = keyed.groupBy("__k").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return keyed.join(groups, "__k").select(key, "first_id", "copies")


def shingles(w: Column, text: Column) -> Column:
    """Distinct shingles of the words of a normal form: five words; single words of shorter texts; the first 64 characters without words.

    ``w`` should be a column of its own: an expression would be computed for each shingle.
    """
    five = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return F.array_distinct(F.when(F.size(w) >= SHINGLE, five).when(F.size(w) > 0, w).otherwise(F.array(F.substring(text, 1, 64))))


def hashed_shingles(df: DataFrame, key: str, text: str, unicode: bool = True) -> DataFrame:
    """(key, h): hashes of each text's shingles."""
    norm = spread(df.select(key, text)).select(key, F.coalesce(text, F.lit("")).alias("__t")).withColumn("__n", normal_form(F.col("__t"), unicode))
    cut_up = norm.select(key, "__t", F.filter(F.split("__n", " "), lambda x: x != "").alias("__w"))
    return cut_up.select(key, F.transform(shingles(F.col("__w"), F.col("__t")), shingle_hash).alias("h"))


def shingle_hash(shingle: Column) -> Column:
    """The first 32 bits of MD5 as a number."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long")


def permutations(n: int = N_PERM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends by a rule on the index, so that other engines can repeat them."""
    i = np.arange(n, dtype=np.int64)
    return (seed * 1_000_003 + i * 7_368_787) % (MODULUS - 1) + 1, (seed * 998_244_353 + i * 15_485_863) % MODULUS


def signatures(df: DataFrame, key: str, text: str, n_perm: int = N_PERM, seed: int = SEED, unicode: bool = True) -> DataFrame:
    """(key, signature): minimum of (a * x + b) mod MODULUS under each permutation, in Arrow batches of hashes that are sent as 4 bytes."""
    a, b = permutations(n_perm, seed)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                lows = np.full((batch.num_rows, n_perm), MODULUS, dtype=np.int64)
                for low, own in zip(lows, batch.column(1), strict=True):
                    x = np.asarray(own.values).astype(np.int64)
                    for i in range(0, len(x), 1024):
                        np.minimum(low, ((x[i : i + 1024, None] * a + b) % MODULUS).min(axis=0), out=low)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lows) + 1, dtype=np.int32) * n_perm), pa.array(lows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "signature"])

    hashed = hashed_shingles(df, key, text, unicode).select(key, F.transform("h", lambda x: (x % MODULUS).cast("int")).alias("h"))
    return hashed.mapInArrow(run, f"`{key}` {kind}, signature array<long>")


def band_rows(sigs: DataFrame, key: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, band, bucket) of every band."""
    cells = [F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice("signature", i * rows + 1, rows), ",")).alias("bucket")) for i in range(bands)]
    return sigs.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.band", "c.bucket")


def candidate_pairs(bands: DataFrame, key: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(a, b) distinct pairs that share a bucket of at most ``most`` members, and the buckets of more, as a report.

    Whole results come from scored_pairs and near_clusters, which leave no bucket out.
    """
    sizes = bands.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    skipped = sizes.where(F.col("size") > most)
    fine = bands.join(sizes.where(F.col("size") <= most).select("band", "bucket"), ["band", "bucket"])
    pairs = fine.select("band", "bucket", F.col(key).alias("a")).join(fine.select("band", "bucket", F.col(key).alias("b")), ["band", "bucket"]).where("a < b")
    return pairs.select("a", "b").distinct(), skipped


def signature_classes(sigs: DataFrame, key: str) -> DataFrame:
    """(key, rep): the smallest key of the same signature."""
    keyed = sigs.where(F.col(key).isNotNull()).select(key, F.md5(F.array_join("signature", ",")).alias("__s"))
    return cut(keyed.join(keyed.groupBy("__s").agg(F.min(key).alias("rep")), "__s").select(key, "rep"))


def every_pair(ids: list, sig: np.ndarray, sides: np.ndarray, band: int, rows: int) -> Iterator[tuple]:
    """(a, b, equal values) of a block's pairs of different sides, or of all if there is one side, whose first common band this is."""
    one = sides.min() == sides.max()
    for r in range(len(ids)) if one else np.flatnonzero(sides == sides.min()):
        others = np.arange(r + 1, len(ids)) if one else np.flatnonzero(sides != sides[r])
        same = sig[others] == sig[r]
        first = same.reshape(len(others), sig.shape[1] // rows, rows).all(axis=2).argmax(axis=1) == band
        for o, n in zip(others[first].tolist(), same[first].sum(axis=1).tolist(), strict=True):
            yield min(ids[r], ids[o]), max(ids[r], ids[o]), n


def spanning_pairs(ids: list, sig: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(a, b, equal values) of enough links of a block to connect all that its links of ``threshold`` connect.

    Rows that have joined the first row's part are not compared: each row that stays outside it meets all others.
    """
    part = np.arange(len(ids))
    for r in range(len(ids)):
        if r and part[r] == part[0]:
            continue
        equal = (sig == sig[r]).sum(axis=1)
        new = np.flatnonzero((equal / float(sig.shape[1]) >= threshold) & (part != part[r]))
        parts, first = np.unique(part[new], return_index=True)
        for o in new[first].tolist():
            yield ids[r], ids[o], int(equal[o])
        part[np.isin(part, parts)] = part[r]


def bucket_pairs(sigs: DataFrame, key: str, threshold: float | None = None, rows: int = ROWS) -> DataFrame:
    """(a, b, equal) of signatures that share a bucket: all pairs, each once, or links that span those of ``threshold``.

    Signatures should differ. A bucket is dealt in groups of about BLOCK members, and each two groups meet in one block, so no bucket is skipped
    and no task holds more than two groups; shuffled rows grow with a bucket's square over BLOCK.
    """
    kind, n_bands = dict(sigs.dtypes)[key], N_PERM // rows
    bands = band_rows(sigs, key, n_bands, rows)
    sizes = bands.groupBy("band", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = bands.join(sizes, ["band", "bucket"]).withColumn("side", F.pmod(F.xxhash64(key), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = cut(dealt.select(key, "band", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side"))
    blocks = dealt.join(sigs.select(key, F.col("signature").cast("array<int>").alias("signature")), key)
    blocks = blocks.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j")
    blocks = blocks.select("band", F.concat_ws(" ", "bucket", "i", "j").alias("block"), F.col("i") != F.col("j"), "side", key, "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(block: list[tuple]) -> Iterator[tuple]:
            _, band, two = block[0][0]
            ids, sig, sides = [x[2] for x in block], np.stack([x[3] for x in block]), np.array([x[1] for x in block])
            if two and sides.min() == sides.max():
                return iter(())  # the other group is empty; this one meets itself in its own block
            return every_pair(ids, sig, sides, band, rows) if threshold is None else spanning_pairs(ids, sig, threshold)

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, b, n = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, ids_type), pa.array(b, ids_type), pa.array(n, pa.int32())], names=["a", "b", "equal"])

        ids_type = None

        def dealt_blocks() -> Iterator[list[tuple]]:
            nonlocal ids_type
            block = []
            for batch in batches:
                ids_type = batch.schema.field(4).type
                sig = np.asarray(batch.column(5).flatten()).reshape(batch.num_rows, N_PERM)
                heads = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
                for head, side, name, own in zip(heads, batch.column(3).to_pylist(), batch.column(4).to_pylist(), sig, strict=True):
                    if block and block[0][0] != head:
                        yield block
                        block = []
                    block.append((head, side, name, own))
            if block:
                yield block

        found = []
        for block in dealt_blocks():
            for pair in met(block):
                found.append(pair)
                if len(found) >= OUT_PAIRS:  # of the last block, too
                    yield out(found)
                    found = []
        if found:
            yield out(found)

    return blocks.mapInArrow(run, f"a {kind}, b {kind}, equal int")


def class_pairs(sigs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of each signature's class and (a, b, equal) of all representatives that share a bucket."""
    members = signature_classes(sigs, key)
    return members, cut(bucket_pairs(sigs.join(members.where(F.col(key) == F.col("rep")).select(key), key), key))


def pair_count(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pairs_scored): how many rows scored_pairs has, from its class_pairs and without writing the classes' pairs out."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    across = pairs.join(sizes.withColumnsRenamed({"rep": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"rep": "b", "n": "nb"}), "b").select((F.col("na") * F.col("nb")).alias("n"))
    both = across.unionByName(sizes.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_scored"))


def scored_pairs(sigs: DataFrame, key: str, n_perm: int = N_PERM) -> DataFrame:
    """(a, b, estimate): share of equal signature values of all pairs that share a bucket.

    Equal signatures are compared once, by their smallest key, and their pairs are written out at the end.
    """
    members, pairs = class_pairs(sigs, key)
    left, right = members.select(F.col("rep").alias("ra"), F.col(key).alias("x")), members.select(F.col("rep").alias("rb"), F.col(key).alias("y"))
    across = pairs.withColumnsRenamed({"a": "ra", "b": "rb"}).join(left, "ra").join(right, "rb")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("equal") / F.lit(float(n_perm))).alias("estimate"))
    within = left.join(right, F.col("ra") == F.col("rb")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("estimate"))
    return across.unionByName(within)


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in a table in the shared folder."""
    return stored(df, "cut")


def clusters(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of all members of clusters of more than one: smallest-label propagation with pointer jumps.

    An error, never a partial result, if labels still change after ``rounds``.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("a"), "root"), "a").groupBy(F.col("b").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.least("root", "near").alias("root"))
        step = cut(step)
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = cut(step.join(jump, "root").select("id", F.col("up").alias("root")))
        moved = after.join(labels.withColumnRenamed("root", "was"), "id").where("root <> was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("clusters did not settle")


def near_clusters(df: DataFrame, key: str, text: str, threshold: float = 0.85, unicode: bool = True) -> DataFrame:
    """(id, root) of texts that share a bucket and an estimate of at least ``threshold``, over any number of links; no bucket is left out."""
    sigs = cut(signatures(df, key, text, unicode=unicode))
    members = signature_classes(sigs, key)
    links = bucket_pairs(sigs.join(members.where(F.col(key) == F.col("rep")).select(key), key), key, threshold)
    return clusters(class_links(members, links, key))


def class_links(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(a, b) of links between representatives and from each to its class."""
    return links.select("a", "b").unionByName(members.where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b")))


def candidate_order(lic: Column, journal_ref: Column, doi: Column, arxiv_id: Column, parse_quality: Column, length: Column, index: Column) -> Column:
    """What a representative is chosen by, best first: license, review, version, parse, length, smallest index."""
    version = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(arxiv_id, F.lit("")), r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    reviewed = (F.coalesce(journal_ref, F.lit("")) != "") | (F.coalesce(doi, F.lit("")) != "")
    return F.struct(licensing.partition_value(licensing.partition(lic)).alias("l"), reviewed.alias("r"), version.alias("v"), F.coalesce(parse_quality, F.lit(0.0)).alias("q"), F.coalesce(length, F.lit(0)).alias("n"), (-index).alias("i"))


def representatives(members: DataFrame, cluster: str, order: Column, index: str) -> DataFrame:
    """(cluster, chosen, members, license_gain): the best member, and whether it is worth more than the least of the others."""
    marked = members.withColumn("__o", order)
    best = marked.groupBy(cluster).agg(F.max("__o").alias("best"), F.max_by(index, "__o").alias("chosen"), F.count("*").alias("members"), F.min("__o.l").alias("least"))
    return best.select(cluster, "chosen", "members", (F.col("best.l") > F.col("least")).alias("license_gain"))
