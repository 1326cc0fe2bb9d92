"""Relational operators on the driver's tables: latest versions, samples, splits, joins, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, sampling, spine
from ._base import Book, t

BOOK = Book()
add = BOOK.add


def hashed(expr: str, seed: int = 17) -> str:
    return f"md5('{seed}|' || CAST({expr} AS VARCHAR))"


def listed(column: str):
    """Numbers of a list as text; engines print lists differently."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@add("w1_keep_latest", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    return spine.keep_latest(t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", "ts", "event_id")


@add("a1_value_counts", """
SELECT event_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY event_type""")
def _(spark, d):
    return spine.value_counts(t(spark, d, "events"), "event_type")


@add("a1_top_counts", """
SELECT source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8""")
def _(spark, d):
    return spine.value_counts(t(spark, d, "documents"), "source", 8)


@add("a2_bucket_share", """
SELECT CAST(floor(year(o_orderdate) / 5) * 5 AS INTEGER) AS bucket, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS share
FROM orders GROUP BY 1 HAVING count(*) >= 100""")
def _(spark, d):
    return spine.bucket_share(t(spark, d, "orders"), (F.floor(F.year("o_orderdate") / 5) * 5).cast("int"), F.col("o_orderstatus") == "F")


@add("a3_summary", """
SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (n_chars >= 1000) AS n_long,
       round(avg(CASE WHEN source = 'src0' THEN 1 ELSE 0 END), 6) AS share_src0 FROM documents""")
def _(spark, d):
    c = F.col
    return spine.summary(t(spark, d, "documents"), {"n_en": c("lang") == "en", "n_long": c("n_chars") >= 1000}, {"share_src0": c("source") == "src0"})


@add("a4_cited_sets", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def _(spark, d):
    out = graph.cited_sets(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", "parts")
    return out.withColumn("parts", listed("parts"))


@add("a5_citer_sets", "SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS orders FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey")
def _(spark, d):
    out = graph.cited_sets(t(spark, d, "lineitem"), "l_partkey", "l_orderkey", "orders")
    return out.withColumn("orders", listed("orders"))


@add("a7_char_sums", """
SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 4.0, 2) AS tokens_estimate FROM documents GROUP BY source""")
def _(spark, d):
    n = F.sum(F.length("text").cast("long"))
    return t(spark, d, "documents").groupBy("source").agg(n.alias("chars"), F.round(n / 4.0, 2).alias("tokens_estimate"))


@add("a9_domain_yield", """
SELECT source, count(*) AS downloaded, count(*) FILTER (n_chars >= 500) AS usable, count(*) FILTER (lang <> 'en') AS contaminated FROM documents GROUP BY source""")
def _(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("downloaded"), F.count_if(F.col("n_chars") >= 500).alias("usable"), F.count_if(F.col("lang") != "en").alias("contaminated"))


@add("a10_completion_marker", """
WITH c AS (SELECT o_orderstatus AS k, count(*) AS n, sum(o_custkey) AS e FROM orders GROUP BY 1)
SELECT CAST(sum(e) AS BIGINT) AS edges, round(100 * sum(CASE WHEN k = 'O' THEN n ELSE 0 END) / sum(n), 4) AS open_pct,
       string_agg(k || '=' || CAST(n AS VARCHAR), ',' ORDER BY k) AS partitions FROM c""")
def _(spark, d):
    out = spine.completion_marker(t(spark, d, "orders"), "o_orderstatus", "o_custkey", "O")
    flat = F.array_join(F.transform(F.map_entries("partitions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("partitions", flat)


@add("a11_exact_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@add("j1_left_counts", """
SELECT c_custkey, n_orders, total FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def _(spark, d):
    sums = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left")


@add("j2_anti_labels", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    toxic = t(spark, d, "labels").where("toxic = 1").select("doc_id")
    return t(spark, d, "documents").select("doc_id", "source").join(toxic, "doc_id", "left_anti")


@add("j4_resolved_edges", """
SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(spark, d):
    works = t(spark, d, "part").select(F.col("p_partkey"), "p_brand")
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), "l_partkey")
    out = graph.resolve_edges(edges, works, "l_orderkey", "l_partkey", "p_partkey", "p_brand")
    return out.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_partkey").alias("p_brand"))


@add("j8_forbidden", """
WITH f AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS forbidden FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, o_custkey, forbidden FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def _(spark, d):
    pairs = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    out = graph.attach_forbidden(pairs, t(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return out.withColumn("forbidden", listed("forbidden"))


@add("j9_members_only", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return graph.members_only(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")


@add("w2_cap_per_anchor", f"""
SELECT l_orderkey, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {hashed('l_partkey')}, l_partkey) AS rn
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE rn <= 3""")
def _(spark, d):
    return graph.cap_per_anchor(t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey", 3)


@add("w3_hash_sample", f"SELECT doc_id, lang FROM documents ORDER BY {hashed('doc_id')}, doc_id LIMIT 100")
def _(spark, d):
    return sampling.hash_sample(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100)


@add("w4_stratified_cap", f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {hashed('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 6""")
def _(spark, d):
    return sampling.stratified_cap(t(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 110, 20)


@add("w5_head_tail_split", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hashed('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= 120 THEN 'train' ELSE 'test' END AS split FROM r WHERE rn <= 120 OR rn > greatest(120, n - 120)""")
def _(spark, d):
    return sampling.head_tail_split(t(spark, d, "documents").select("doc_id"), "doc_id", 120)


@add("w6_split_by_anchor", f"""
WITH a AS (SELECT l_orderkey, row_number() OVER (ORDER BY {hashed('l_orderkey')}, l_orderkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN rn <= greatest(1, floor(n * 0.02)) THEN 'validation' ELSE 'train' END AS split FROM lineitem l JOIN a ON a.l_orderkey = l.l_orderkey""")
def _(spark, d):
    a, b = sampling.split_by_anchor(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("validation")))


@add("j7_leakage_guard", "SELECT CAST(0 AS BIGINT) AS leaked")
def _(spark, d):
    a, b = sampling.split_by_anchor(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return sampling.leaked(a, b, "l_orderkey").agg(F.count("*").alias("leaked"))


@add("u1_union", "SELECT doc_id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def _(spark, d):
    a = t(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"))
    return a.unionByName(t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("kind")))


@add("u2_union_keep_first", """
WITH u AS (SELECT doc_id, 0 AS pri, lang AS tag FROM documents UNION ALL SELECT doc_id, 1, 'label' FROM labels UNION ALL SELECT page_id, 2, 'page' FROM pages)
SELECT doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pri, tag) AS rn FROM u) WHERE rn = 1""")
def _(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("lang").alias("tag"))
    labels = t(spark, d, "labels").select("doc_id", F.lit("label").alias("tag"))
    pages = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("tag"))
    return sampling.union_keep_first([docs, labels, pages], "doc_id")


@add("u3_distinct_edges", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@add("m3_labelled_set", f"""
WITH neg AS (SELECT doc_id, lang AS domain FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
n AS (SELECT doc_id, domain, 0 AS label FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {hashed('doc_id')}, doc_id) AS rn FROM neg) WHERE rn <= 30),
p AS (SELECT doc_id, 'positive' AS domain, 1 AS label FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ORDER BY {hashed('doc_id')}, doc_id LIMIT 90)
SELECT * FROM n UNION ALL SELECT * FROM p""")
def _(spark, d):
    docs = t(spark, d, "documents")
    good = t(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return sampling.labelled_set(good, {x: docs.where(F.col("lang") == x).select("doc_id") for x in ("de", "es", "fr")}, "doc_id", 90)


@add("p18_review_sample", """
SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn % 97 = 0 AND lang = 'en' ORDER BY rn LIMIT 400""")
def _(spark, d):
    return sampling.review_sample(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "en").select("doc_id")


@add("s6_calendar_slices", """
SELECT strftime(greatest(make_date(y, 1, 1), DATE '2005-09-16'), '%Y-%m-%d') AS slice_from, strftime(least(make_date(y, 12, 31), DATE '2026-03-05'), '%Y-%m-%d') AS slice_until
FROM (SELECT CAST(unnest(range(2005, 2027)) AS INTEGER) AS y)""")
def _(spark, d):
    return sampling.calendar_slices(spark, "2005-09-16", "2026-03-05")


@add("r1_citation_pairs", f"""
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey <> l_partkey),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {hashed('l_partkey')}, l_partkey) AS rn FROM e) WHERE rn <= 8),
x AS (SELECT doc_id, text FROM documents WHERE length(text) >= 120)
SELECT c.l_orderkey, c.l_partkey, sha256(a.text) AS anchor, sha256(b.text) AS positive FROM c JOIN x a ON a.doc_id = c.l_orderkey JOIN x b ON b.doc_id = c.l_partkey""")
def _(spark, d):
    out = graph.citation_pairs(t(spark, d, "lineitem"), t(spark, d, "documents"), "l_orderkey", "l_partkey", "doc_id", "text")
    return out.select("l_orderkey", "l_partkey", F.sha2("anchor", 256).alias("anchor"), F.sha2("positive", 256).alias("positive"))


@add("r4_cocitation", f"""
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
neg AS (SELECT p_partkey AS pos, 1 + (p_partkey * 7 + k * 131) % (SELECT max(p_partkey) FROM part) AS neg FROM part, (SELECT unnest(range(0, 8)) AS k))
SELECT pos, neg FROM neg n WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = n.pos AND b.l_partkey = n.neg)""")
def _(spark, d):
    part = t(spark, d, "part").select("p_partkey")
    top = part.agg(F.max("p_partkey").alias("m"))
    neg = part.join(F.broadcast(top)).select(F.col("p_partkey").alias("pos"), "m", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    neg = neg.select("pos", (F.lit(1) + (F.col("pos") * 7 + F.col("k") * 131) % F.col("m")).alias("neg"))
    return graph.drop_cocited(neg, t(spark, d, "lineitem"), "pos", "neg", "l_orderkey", "l_partkey")
