"""Ranked text search and the fusion of ranked lists as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import huber, lexical, lineage, retrieval, sampling, significance, vectors
from ..operators._tables import delete, new_path
from ..streaming import upsert
from ._base import Book, t

BOOK = Book()
add = BOOK.add

TERMS = f"regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.WORD}')"
BM25 = f"""
w AS (SELECT doc_id AS doc, unnest({TERMS}) AS term FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY doc, term),
dl AS (SELECT doc, sum(tf) AS len FROM tf GROUP BY doc),
st AS (SELECT CAST((SELECT count(DISTINCT doc_id) FROM documents) AS DOUBLE) AS n, CAST((SELECT sum(len) FROM dl) AS DOUBLE) AS words),
df AS (SELECT term, round(ln(1 + (any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)), 9) AS idf FROM tf, st GROUP BY term),
q AS (SELECT DISTINCT item_id AS query, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
sc AS (SELECT query, doc, CAST(sum(CAST(floor(1000000e0 * (idf * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / (words / n)))))) AS BIGINT)) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc), st GROUP BY query, doc)"""


def bm25(spark, d, k: int):
    path = new_path(spark, "index")
    try:
        index = lexical.inverted_index(t(spark, d, "documents"), path)
        found = lexical.search(index, t(spark, d, "benchmark"), k)
        index.drop()
        return found
    finally:
        delete(spark, path)


@add("bm25_documents", f"""
WITH {BM25} SELECT query, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM sc) WHERE rank <= 10""")
def _(spark, d):
    """The ten best documents of every benchmark text."""
    return bm25(spark, d, 10)


DEPTHS = (50, 32)


@add("rrf_text_and_vectors", f"""
WITH {BM25},
t AS (SELECT query, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn FROM sc) WHERE rn <= {DEPTHS[0]}),
a AS (SELECT query, doc AS candidate, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM t),
v AS (SELECT q.vec_id // 20 AS query, p.vec_id AS candidate, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
x AS (SELECT query, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rn FROM v) WHERE rn <= {DEPTHS[1]}),
b AS (SELECT query, candidate, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM x),
f AS (SELECT query, candidate, coalesce(1e0 / (60 + a.r), 0) + coalesce(1e0 / (60 + b.r), 0) AS score, a.r AS rank_0, b.r AS rank_1 FROM a FULL JOIN b USING (query, candidate))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, candidate) AS INTEGER) AS rank FROM f) WHERE rank <= 20""")
def _(spark, d):
    """Text and vector lists of the same queries, fused: item i's text and the vector 20 i; a document's vector is the one of its id."""
    text = lexical.ranked(bm25(spark, d, DEPTHS[0]), "query", "doc", "score", DEPTHS[0])
    vectors = t(spark, d, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0")
    found = retrieval.top_k(queries, vectors, "vec_id", "embedding", DEPTHS[1] + 1).where("query <> candidate")
    order = F.row_number().over(retrieval.Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate"))
    found = found.withColumn("n", order).where(F.col("n") <= DEPTHS[1]).withColumn("query", F.expr("query div 20"))
    return lexical.fused_top([text, lexical.ranked(found, "query", "candidate", "score", DEPTHS[1])], 20)


@add("embedding_contamination", """
WITH s AS (SELECT q.vec_id AS item, p.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS rn, count(*) OVER (PARTITION BY vec_id) AS n FROM s WHERE score >= 0.4)
SELECT e.vec_id, coalesce(n, 0) AS n_items, item AS best_item, score AS best_score, n IS NOT NULL AS contaminated FROM embeddings e LEFT JOIN h ON h.vec_id = e.vec_id AND rn = 1""")
def _(spark, d):
    """Every row's similar test items. The vectors of ids divisible by 20 stand for the items; at random few pairs reach 0.4."""
    rows = t(spark, d, "embeddings")
    return vectors.contamination(rows, rows.where("vec_id % 20 = 0"), 0.4, "vec_id", "embedding")


@add("d11_semantic_duplicates")
def _(spark, d):
    """Which vectors go as semantic duplicates; the cells depend on sums of floating point numbers, so there is no SQL."""
    return vectors.semantic_duplicates(t(spark, d, "embeddings"), "vec_id", "embedding", 0.9)


@add("w1_stream_upsert", "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    """Events as eight files of a stream that ends in the latest row of each user."""
    events = t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    folder = new_path(spark, "upsert")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    table = upsert.UpsertTable(spark, f"{folder}/table", schema, "user_id", "ts", "event_id")
    upsert.upsert_files(table, f"{folder}/in", f"{folder}/checkpoint", files_per_batch=3)
    table.forget()
    delete(spark, f"{folder}/in")
    return table.read()


def sql_p(z: str) -> str:
    """The expression of ``significance.two_sided_p``."""
    series = "0e0"
    for c in reversed(significance.ERFC):
        series = f"(({series} + {c!r}::DOUBLE) * (1 / (1 + {significance.ERFC_P!r}::DOUBLE * (abs({z}) / sqrt(2e0)))))"
    return f"({series} * exp(-(abs({z}) / sqrt(2e0)) * (abs({z}) / sqrt(2e0))))"


@add("wilcoxon_positions", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1:32] AS DOUBLE[]) AS h FROM embeddings),
s AS (SELECT q.vec_id AS query, p.vec_id AS cand, round(list_dot_product(q.v, p.v), 6) AS a, round(list_dot_product(q.h, p.h), 6) AS b FROM e q, e p WHERE q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
o AS (SELECT query, min(a) AS oa, min(b) AS ob FROM s WHERE cand = query + 1 GROUP BY query),
r AS (SELECT s.query, count(*) FILTER (a > oa) - count(*) FILTER (b > ob) AS d FROM s JOIN o USING (query) GROUP BY s.query),
k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY abs(d)) AS g FROM r WHERE d <> 0),
w AS (SELECT count(*) AS n, (SELECT count(*) FROM r WHERE d = 0) AS zero, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus, CAST(sum(g * g - 1) AS DOUBLE) AS ties FROM k),
z AS (SELECT *, (w_plus - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48) AS z FROM w)
SELECT n, zero, w_plus, w_minus, round(z, 6) AS z, round({sql_p('z')}, 6) AS p FROM z""")
def _(spark, d):
    """Whether the first half of each vector ranks the true row (the next id) as well as the whole vector."""
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    halves = rows.select("vec_id", F.slice("v", 1, 32).alias("v"))
    a, b = (retrieval.counted_positions(x.where("vec_id % 20 = 0"), x, "vec_id", "v", F.col("vec_id") + 1) for x in (rows, halves))
    pairs = a.select("query", F.col("pos").alias("pa")).join(b.select("query", F.col("pos").alias("pb")), "query")
    out = significance.wilcoxon(pairs, "pa", "pb")
    return out.select("n", "zero", "w_plus", "w_minus", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@add("fdr_returned_parts", f"""
WITH r AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS rate FROM lineitem),
k AS (SELECT l_partkey, (count(*) FILTER (l_returnflag = 'R') - count(*) * any_value(rate)) / sqrt(count(*) * any_value(rate) * (1 - any_value(rate))) AS z FROM lineitem, r GROUP BY l_partkey),
p AS (SELECT l_partkey, {sql_p('z')} AS p FROM k),
c AS (SELECT l_partkey, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p),
q AS (SELECT l_partkey, p, least(1e0, min(raw) OVER (ORDER BY p DESC)) AS q FROM c)
SELECT l_partkey, round(p, 8) AS p, round(q, 8) AS q, q <= 0.2 AS rejected FROM q""")
def _(spark, d):
    """Parts that are returned more or less often than all are, each a test of its own, at a false discovery rate of 20 %."""
    lines = t(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").cast("double").alias("r"))
    rate = lines.agg(F.avg("r").alias("rate"))
    parts = lines.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("r").alias("k")).crossJoin(F.broadcast(rate))  # one row
    z = (F.col("k") - F.col("n") * F.col("rate")) / F.sqrt(F.col("n") * F.col("rate") * (1 - F.col("rate")))
    out = significance.false_discovery(parts.select("l_partkey", significance.two_sided_p(z).alias("p")), "p", 0.2)
    return out.select("l_partkey", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"), "rejected")


@add("m2_huber_classifier")
def _(spark, d):
    """Train on two thirds of the labelled documents, score the others; optimised by gradients of floating point sums, so without SQL."""
    df = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = huber.train(df.where("doc_id % 3 <> 0"), steps=15)
    p = huber.scored(model, df.where("doc_id % 3 = 0"))
    return p.select("doc_id", F.round(F.col("p")[1], 6).alias("score"), (F.col("p")[1] >= 0.5).cast("int").alias("predicted"))


@add("s6_order_slices", """
WITH e AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
y AS (SELECT CAST(unnest(range(CAST(year(a) AS BIGINT), CAST(year(b) + 1 AS BIGINT))) AS INTEGER) AS y, a, b FROM e),
s AS (SELECT y, strftime(greatest(make_date(y, 1, 1), a), '%Y-%m-%d') AS slice_from, strftime(least(make_date(y, 12, 31), b), '%Y-%m-%d') AS slice_until FROM y)
SELECT slice_from, slice_until, count(o_orderkey) AS n FROM s LEFT JOIN orders ON year(CAST(o_orderdate AS DATE)) = y GROUP BY ALL""")
def _(spark, d):
    """Calendar slices from the first to the last order, and the orders of each."""
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    ends = orders.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    slices = sampling.calendar_slices(spark, str(ends.a), str(ends.b))
    counts = orders.groupBy(F.year("day").alias("y")).agg(F.count("o_orderkey").alias("n"))
    return slices.join(counts, F.substring("slice_from", 1, 4).cast("int") == F.col("y"), "left").select("slice_from", "slice_until", F.coalesce("n", F.lit(0)).alias("n"))


HALVES = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1:32] AS DOUBLE[]) AS h FROM embeddings),
s AS (SELECT q.vec_id AS query, p.vec_id AS cand, round(list_dot_product(q.v, p.v), 6) AS a, round(list_dot_product(q.h, p.h), 6) AS b FROM e q, e p WHERE q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
o AS (SELECT query, min(a) AS oa, min(b) AS ob FROM s WHERE cand = query + 1 GROUP BY query),
r AS (SELECT s.query, 1 + count(*) FILTER (a > oa) AS pa, 1 + count(*) FILTER (b > ob) AS pb FROM s JOIN o USING (query) GROUP BY s.query)"""


def halves(spark, d):
    """Positions of the true row (the next id) by whole vectors and by their first halves."""
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    cut = rows.select("vec_id", F.slice("v", 1, 32).alias("v"))
    return [retrieval.counted_positions(x.where("vec_id % 20 = 0"), x, "vec_id", "v", F.col("vec_id") + 1) for x in (rows, cut)]


@add("r9_position_groups", f"WITH {HALVES} SELECT count(*) AS n, round(avg(CASE WHEN pa = 1 THEN 1 ELSE 0 END), 6) AS top_1, round(avg(1.0 / pa), 6) AS mrr, round(avg(1.0 / (SELECT count(*) - 1 FROM embeddings)), 6) AS chance FROM r")
def _(spark, d):
    """Group metrics of w9's positions; a query's group are all other rows."""
    size = t(spark, d, "embeddings").agg((F.count("*") - 1).alias("size"))
    return retrieval.group_metrics(halves(spark, d)[0].crossJoin(F.broadcast(size)), "pos", "size")  # one row


@add("r10_paired_positions", f"WITH {HALVES} SELECT count(pa) AS n_a, count(pb) AS n_b, count(*) FILTER (pa <= 50 AND pb > 50) AS only_a, count(*) FILTER (pb <= 50 AND pa > 50) AS only_b FROM r")
def _(spark, d):
    """Queries whose true row only one of the two rankings has among its first 50."""
    return retrieval.paired_counts(*halves(spark, d), "query", at=50)


@add("h5_text_versions", """
WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(length(text) AS BIGINT) AS size, sha256(text) AS h FROM documents WHERE n_chars >= 300),
n AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(length(trim(text, chr(10))) AS BIGINT) AS size, sha256(replace(trim(text, chr(10)), chr(9), ' ')) AS h FROM documents WHERE n_chars < 5000)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'absent' WHEN o.path IS NULL THEN 'extra' ELSE 'altered' END AS kind
FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR coalesce(o.h <> n.h, false)""")
def _(spark, d):
    """What differs between an index of the longer texts and one of the shorter texts after a cleaning step."""
    rows = t(spark, d, "documents")
    path, clean = F.col("doc_id").cast("string").alias("path"), F.trim("text", F.lit("\n"))
    old = rows.where("n_chars >= 300").select(path, F.length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    new = rows.where("n_chars < 5000").select(path, F.length(clean).cast("long").alias("size"), F.sha2(F.translate(clean, "\t", " ").cast("binary"), 256).alias("sha256"))
    return lineage.divergences(old, new)


@add("j7_shared_orders", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber >= 5 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    """What the guard finds in a split that is not sound: lines whose order also stands on the training side."""
    lines = t(spark, d, "lineitem")
    return sampling.leaked(lines.where("l_returnflag = 'R'"), lines.where("l_linenumber >= 5").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
