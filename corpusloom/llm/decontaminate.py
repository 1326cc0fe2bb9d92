"""Benchmark decontamination: document windows looked up in a hash set of normalised test n-grams.

A window of m words holds, at whatever word it starts, one of every (m - b + 1)-th positions at which a
block of b words fits wholly inside it. So a document is probed at every (m - b + 1)-th position only, for windows of all
lengths in one pass; only hashes and positions leave that pass. Documents with a known block are met again, and the
windows around it are compared word for word. All is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, free_name, read_table, stored
from .line_dedup import NO_ID, ascii_lower

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Bytes of test windows that are broadcast, at most.
MAX_BROADCAST_BYTES = 64 << 20


def block_and_step(m: int) -> tuple[int, int]:
    """Words of a block of windows of m words, and the distance of the positions that are probed."""
    block = (m + 1) // 2
    return block, m - block + 1


def words_of(text: Column) -> Column:
    """Words of a text; null gives none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT, -1), lambda w: w != "")


def item_windows(bench: DataFrame, item_id: str, text_col: str, n: int) -> DataFrame:
    """(m, pos, window, item) of every window: n words, or all words of a shorter item."""
    items = bench.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.withColumn("m", F.least(F.size("w"), F.lit(n))).where("m > 0")
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("pos")
    rows = items.select("item", "m", "w", starts)
    return rows.select("item", "m", F.slice("w", F.col("pos") + 1, F.col("m")).alias("window"))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(oid, th, start, m, item): every place where a test window stands in a document.

    ``oid`` is the document id (2**63 - 1 for none) and ``th`` the hash of its text, so that rows of one id
    and different texts stay apart. The windows and their hashes are broadcast while they have at most ``max_broadcast_bytes``
    and are joined by shuffle beyond that. An empty table on either side gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    windows = item_windows(bench, item_id, item_text, n)
    windows = scratch.stored(windows.select("m", F.array_join("window", " ").alias("words"), "window", "item").distinct(), "test-windows")
    sizes = windows.groupBy("m").agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16 * F.col("m")).alias("bytes")).collect()  # at most n rows
    if not sizes:
        return docs.sparkSession.createDataFrame([], "oid long, th long, start int, m int, item string")
    small = sum(r["bytes"] for r in sizes) <= max_broadcast_bytes
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("oid"), F.xxhash64(text).alias("th"), F.col(text_col).alias("text"))

    def probes(m: int) -> Column:
        block, step = block_and_step(m)
        at = F.sequence(F.lit(0), F.size("w") - block, F.lit(step))
        return F.when(F.size("w") >= m, F.transform(at, lambda p: F.struct(F.lit(m).alias("m"), p.alias("at"), F.xxhash64(F.slice("w", p + 1, block)).alias("h")))).otherwise(F.array().cast("array<struct<m:int,at:int,h:bigint>>"))

    lengths = sorted(r["m"] for r in sizes)
    rows = base.select("oid", "th", words_of(F.col("text")).alias("w")).select("oid", "th", F.explode(F.concat(*[probes(m) for m in lengths])).alias("p")).select("oid", "th", "p.m", "p.at", "p.h")
    block = F.floor((F.col("m") + 1) / 2).cast("int")
    blocks = windows.select("m", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - block), lambda p: F.xxhash64(F.slice("window", p + 1, block)))).alias("h"))
    found = rows.join(held(blocks.distinct()), ["m", "h"]).groupBy("oid", "th").agg(F.collect_set(F.struct("m", "at")).alias("near"))
    found = scratch.stored(found, "test-candidates")
    met = base.join(found, ["oid", "th"]).select("oid", "th", "near", words_of(F.col("text")).alias("w"))

    def around(c: Column) -> Column:
        """The windows that hold the block at ``c.at``."""
        m = c["m"]
        block = F.floor((m + 1) / 2).cast("int")
        first, last = F.greatest(F.lit(0), c["at"] - (m - block)), F.least(c["at"], F.size("w") - m)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(m.alias("m"), p.alias("start"), F.array_join(F.slice("w", p + 1, m), " ").alias("words")))

    places = met.select("oid", "th", F.explode(F.flatten(F.transform("near", around))).alias("p")).select("oid", "th", "p.m", "p.start", "p.words")
    return places.join(held(windows.select("m", "words", "item")), ["m", "words"]).select("oid", "th", "start", "m", "item")


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "mark", n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Find test windows in documents and mark them, or remove documents or words.

    ``mode``: "mark" adds n_words, n_hit, n_items, items (sorted test ids, as strings) and contaminated;
    "documents" leaves out contaminated documents; "spans" removes the hit words from contaminated
    texts (their other words are then lower-cased and joined by spaces). Null and empty texts have no words and
    are never hit; repeated rows get the same marks each; extra columns stay, those named like a mark are replaced.
    A text of any length takes time in proportion to it. Words of an item without an id are hit, but it is in no list of items. Empty tables give no hits.
    """
    marks = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    oid, th, spots_in, items_in, w = free_name(docs.drop(*marks) if mode == "mark" else docs, "oid", "th", "spots", "items_found", "w")
    with Scratch(docs.sparkSession) as scratch:
        hits = find_hits(docs, bench, n, id_col, text_col, item_id, item_text, max_broadcast_bytes, scratch)
        spots = hits.select("oid", "th", "item", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("spot"))
        per_doc = spots.groupBy("oid", "th").agg(F.collect_set("spot").alias(spots_in), F.sort_array(F.collect_set("item")).alias(items_in))
        per_doc = stored(per_doc.withColumnsRenamed({"oid": oid, "th": th}), "test-hits")
    left = docs.withColumns({oid: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    if mode == "documents":
        return left.join(per_doc, [oid, th], "left_anti").drop(oid, th)
    if mode == "spans":
        out = left.join(per_doc, [oid, th], "left").withColumn(w, words_of(F.col(text_col)))  # a column, so that it is split once
        stay = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col(spots_in))
        kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(w), i)), " ")
        return out.withColumn(text_col, F.when(F.col(spots_in).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
    left = left.drop(*marks).withColumn("n_words", F.size(words_of(F.col(text_col))).cast("long"))
    out = left.join(per_doc, [oid, th], "left")
    return out.withColumns({
        "n_hit": F.coalesce(F.size(spots_in), F.lit(0)).cast("long"),
        "n_items": F.coalesce(F.size(items_in), F.lit(0)).cast("long"),
        "items": F.coalesce(items_in, F.array().cast("array<string>")),
        "contaminated": F.col(spots_in).isNotNull(),
    }).drop(oid, th, spots_in, items_in)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bn AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS p FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bn),
dn AS (
  SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS p FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT dn.doc_id, dn.p, dn.m, bn.item FROM dn JOIN bn ON dn.m = bn.m AND dn.win = bn.win),
spots AS (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS s FROM hit),
ns AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN ns ON ns.doc_id = dw.doc_id LEFT JOIN ni ON ni.doc_id = dw.doc_id
"""
