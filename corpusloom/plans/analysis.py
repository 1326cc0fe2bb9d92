"""Duplicates, retrieval, calibration, audits, LaTeX, verification and lineage as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex
from ..operators import audit, classify, dedup, graph, lineage, retrieval, verify
from ..operators._tables import Tables, new_path
from ..streaming import incremental
from ._base import Book, t, values
from .relational import hashed
from .texts import NORM

BOOK = Book()
add = BOOK.add

WORDS = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"
SHINGLES = f"""s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN w ELSE [substr(text, 1, 64)] END) AS sh
  FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)),
h AS (SELECT doc_id, CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) AS v FROM (SELECT doc_id, unnest(sh) AS x FROM s))"""


@add("d1_exact_groups", f"""
WITH k AS (SELECT doc_id, sha256({NORM}) AS k FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM k""")
def _(spark, d):
    return dedup.exact_groups(t(spark, d, "documents"), "doc_id", "text")


@add("d2_shingles", f"WITH {SHINGLES} SELECT doc_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM h GROUP BY doc_id")
def _(spark, d):
    df = dedup.hashed_shingles(t(spark, d, "documents"), "doc_id", "text")
    return df.select("doc_id", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_A, _B = dedup.permutations()


@add("d3_signatures", f"""
WITH {SHINGLES}
SELECT doc_id, {', '.join(f'min(({int(_A[i])} * (v % {dedup.MODULUS}) + {int(_B[i])}) % {dedup.MODULUS}) AS s{i}' for i in range(dedup.N_PERM))} FROM h GROUP BY doc_id""")
def _(spark, d):
    sigs = dedup.signatures(t(spark, d, "documents"), "doc_id", "text")
    return sigs.select("doc_id", *[F.col("signature")[i].alias(f"s{i}") for i in range(dedup.N_PERM)])


PERMUTED = values([(i, int(_A[i]), int(_B[i])) for i in range(dedup.N_PERM)], "i, a, b")
SIGNED = f"""{SHINGLES}, p AS (SELECT i, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {PERMUTED}),
g AS (SELECT doc_id, i, min((a * (v % {dedup.MODULUS}) + b) % {dedup.MODULUS}) AS m FROM h, p GROUP BY doc_id, i),
b AS (SELECT doc_id, i // 8 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS bucket FROM g GROUP BY doc_id, i // 8),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
e AS (SELECT c.a, c.b, sum(CASE WHEN x.m = y.m THEN 1 ELSE 0 END) / 128.0 AS estimate FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.i = x.i GROUP BY c.a, c.b)"""


@add("d4_d6_scored_pairs", f"WITH {SIGNED} SELECT a, b, CAST(estimate AS DOUBLE) AS estimate FROM e")
def _(spark, d):
    sigs = dedup.cut(dedup.signatures(t(spark, d, "documents"), "doc_id", "text"))
    return dedup.scored_pairs(sigs, "doc_id")


@add("d5_skipped_buckets", f"""
WITH {SHINGLES}, p AS (SELECT i, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {PERMUTED}),
g AS (SELECT doc_id, i, min((a * (v % {dedup.MODULUS}) + b) % {dedup.MODULUS}) AS m FROM h, p GROUP BY doc_id, i),
b AS (SELECT doc_id, i // 8 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS bucket FROM g GROUP BY doc_id, i // 8)
SELECT size, count(*) AS buckets FROM (SELECT band, bucket, count(*) AS size FROM b GROUP BY band, bucket) WHERE size > {dedup.MOST} GROUP BY size""")
def _(spark, d):
    bands = dedup.band_rows(dedup.signatures(t(spark, d, "documents"), "doc_id", "text"), "doc_id")
    _, skipped = dedup.candidate_pairs(bands, "doc_id", dedup.MOST)
    return skipped.groupBy("size").agg(F.count("*").alias("buckets"))


@add("d7_clusters", f"""
WITH RECURSIVE {SIGNED}, l AS (SELECT a, b FROM e WHERE estimate >= 0.85 UNION ALL SELECT b, a FROM e WHERE estimate >= 0.85),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT id, min(root) AS root FROM r GROUP BY id""")
def _(spark, d):
    return dedup.near_clusters(t(spark, d, "documents"), "doc_id", "text")


CANDIDATES = [
    (1, 10, None, "J", None, "2001.00001v3", 0.9, 100), (1, 11, "http://creativecommons.org/licenses/by/4.0/", None, None, "2001.00001", 0.1, 10), (2, 20, None, None, None, "2001.00002v1", 0.5, 5),
    (2, 21, None, None, None, "2001.00002v3", 0.5, 5), (3, 30, "http://creativecommons.org/licenses/by-nc-nd/4.0/", None, None, None, 0.0, 0), (4, 40, None, None, None, None, 0.0, 7), (4, 41, None, None, None, None, 0.0, 7),
]


@add("d9_representatives", f"""
WITH c AS (SELECT *, CASE WHEN lic LIKE '%/by/%' THEN 3 WHEN lic LIKE '%by-nc%' THEN 1 ELSE 2 END AS l, (coalesce(jr, '') <> '' OR coalesce(doi, '') <> '') AS r,
  coalesce(TRY_CAST(nullif(regexp_extract(coalesce(aid, ''), 'v(\\d+)$', 1), '') AS INTEGER), 1) AS v FROM {values(CANDIDATES, 'cluster, idx, lic, jr, doi, aid, q, n')}),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY l DESC, r DESC, v DESC, q DESC, n DESC, idx) AS rn, count(*) OVER (PARTITION BY cluster) AS members, min(l) OVER (PARTITION BY cluster) AS least FROM c)
SELECT cluster, idx AS chosen, members, l > least AS license_gain FROM b WHERE rn = 1""")
def _(spark, d):
    df = spark.createDataFrame(CANDIDATES, "cluster int, idx int, lic string, jr string, doi string, aid string, q double, n int")
    c = F.col
    return dedup.representatives(df, "cluster", dedup.candidate_order(c("lic"), c("jr"), c("doi"), c("aid"), c("q"), c("n"), c("idx")), "idx")


# cosine search: vectors of the driver have unit length
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE)))"
SEARCH = f"""s AS (SELECT q.vec_id AS query, c.vec_id AS candidate, c.label, q.label AS ql, round({DOT}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)"""


def _search(spark, d, k):
    vectors = t(spark, d, "embeddings")
    found = retrieval.top_k(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", k + 1)
    return found.where("query <> candidate")


@add("w8_top_k", f"WITH {SEARCH} SELECT query, candidate FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rn FROM s) WHERE rn <= 8")
def _(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate"))
    return _search(spark, d, 8).withColumn("rn", rank).where("rn <= 8").select("query", "candidate")


@add("r2_hard_negatives", f"""
WITH {SEARCH}, k AS (SELECT query, candidate, label, ql FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rn FROM s) WHERE rn <= 32),
m AS (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM (SELECT s.* FROM s JOIN k USING (query, candidate)) WHERE label <> ql)
SELECT query, candidate, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 8""")
def _(spark, d):
    vectors = t(spark, d, "embeddings").select("vec_id", "label")
    found = _search(spark, d, 32)
    # what a query cites here: the candidates of its own label among those found
    cites = found.join(vectors.select(F.col("vec_id").alias("query"), F.col("label").alias("lq")), "query").join(vectors.select(F.col("vec_id").alias("candidate"), "label"), "candidate").where("lq = label")
    edges = cites.select("query", F.col("candidate").alias("cited"))
    return graph.exclude_cited(found.drop("rank"), edges, "query", "candidate", "cited", "score", 8).select("query", "candidate", "rank")


POSITIONS = f"""{SEARCH}, o AS (SELECT query, min(score) AS own FROM s WHERE candidate = query + 1 GROUP BY query),
pos AS (SELECT s.query, 1 + count(*) FILTER (s.score > o.own) AS pos FROM s JOIN o USING (query) GROUP BY s.query)"""


def _positions(spark, d):
    vectors = t(spark, d, "embeddings")
    return retrieval.counted_positions(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", F.col("vec_id") + 1)


@add("w9_positions", f"WITH {POSITIONS} SELECT query, pos FROM pos")
def _(spark, d):
    return _positions(spark, d)


@add("r8_rank_metrics", f"""
WITH {POSITIONS} SELECT count(*) AS n, round(avg(CASE WHEN pos <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN pos <= 10 THEN 1 ELSE 0 END), 6) AS recall_10,
  round(avg(1.0 / pos), 6) AS mrr, round(avg(CASE WHEN pos <= 10 THEN 1 / log2(1 + pos) ELSE 0 END), 6) AS ndcg_10 FROM pos""")
def _(spark, d):
    return retrieval.rank_metrics(_positions(spark, d))


RANKS = [(i, 1 + (i * 7) % 5, 1 + (i * 3) % 4, 8) for i in range(60)]


@add("r9_group_metrics", f"SELECT count(*) AS n, round(avg(CASE WHEN a = 1 THEN 1 ELSE 0 END), 6) AS top_1, round(avg(1.0 / a), 6) AS mrr, round(avg(1.0 / g), 6) AS chance FROM {values(RANKS, 'q, a, b, g')}")
def _(spark, d):
    return retrieval.group_metrics(spark.createDataFrame(RANKS, "q int, a int, b int, g int"), "a", "g")


@add("r10_paired_counts", f"SELECT count(a) AS n_a, count(b) AS n_b, count(*) FILTER (a <= 1 AND b > 1) AS only_a, count(*) FILTER (b <= 1 AND a > 1) AS only_b FROM {values(RANKS, 'q, a, b, g')}")
def _(spark, d):
    df = spark.createDataFrame(RANKS, "q int, a int, b int, g int")
    return retrieval.paired_counts(df.select("q", F.col("a").alias("pos")), df.select("q", F.col("b").alias("pos")), "q")


MASKED = [(1, 0, "a", ["b", "x"]), (1, 1, "b", []), (1, 2, graph.NO_NEGATIVE, ["a"]), (2, 0, "c", ["c"])]


@add("r5_batch_mask", f"""
WITH m AS (SELECT * FROM {values(MASKED, 'batch, r, neg, bad')})
SELECT x.batch, x.r AS "row", y.r AS other, list_contains(x.bad, y.neg) OR y.neg = '{graph.NO_NEGATIVE}' AS masked FROM m x JOIN m y ON x.batch = y.batch""")
def _(spark, d):
    return graph.batch_mask(spark.createDataFrame(MASKED, "batch int, row int, neg string, bad array<string>"), "batch", "row", "neg", "bad")


NEGATIVES = [(1, "p", ["a", "b", "c", "d"]), (2, "p", ["a", "b"]), (3, "p", []), (4, "q", None)]


@add("r6_rerank_groups", f"""
WITH n AS (SELECT * FROM {values(NEGATIVES, 'id, pos, neg')}),
s AS (SELECT id, list(x ORDER BY md5('17|' || CAST(id AS VARCHAR) || '|' || x), x) AS o FROM (SELECT id, unnest(neg) AS x FROM n) GROUP BY id)
SELECT n.id, array_to_string(list_concat([pos], CASE WHEN coalesce(len(neg), 0) >= 3 THEN o[1:3] WHEN coalesce(len(neg), 0) > 0 THEN list_transform(range(0, 3), lambda i: neg[i % len(neg) + 1]) ELSE [pos, pos, pos] END), ',') AS grp
FROM n LEFT JOIN s ON s.id = n.id""")
def _(spark, d):
    df = spark.createDataFrame(NEGATIVES, "id int, pos string, neg array<string>")
    return df.select("id", F.array_join(graph.rerank_group(F.col("pos"), F.col("neg"), 3, F.col("id")), ",").alias("grp"))


@add("r7_pooling", """
WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT vec_id, "at", CASE WHEN abs(value) < 0.00005 THEN 0.0 ELSE round(value, 4) END AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS "at", unnest(embedding) / n AS value FROM v)""")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.transform(v, lambda x: F.lit(0.0))
    pooled = t(spark, d, "embeddings").select("vec_id", retrieval.pooled(F.array(v, v, zero), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("p"))
    return pooled.select("vec_id", F.posexplode("p").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.when(F.abs("x") < 0.00005, 0.0).otherwise(F.round("x", 4)).alias("value"))


# a reproducible score in hundredths stands for a model
SCORE_SQL = "(CASE WHEN quality = 1 THEN 30 ELSE 0 END + CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 70) / 100.0"


def _scored(spark, d):
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 70
    return t(spark, d, "labels").withColumn("s", (F.when(F.col("quality") == 1, 30).otherwise(0) + draw) / 100.0)


@add("m4_calibrated", f"""
WITH s AS (SELECT quality, CAST({SCORE_SQL} AS DOUBLE) AS s FROM labels), c AS (SELECT unnest([0, 1]) AS class),
r AS (SELECT class, CAST(round((CASE WHEN class = 1 THEN s ELSE 1 - s END) * 100) AS INTEGER) AS bin, quality = class AS hit FROM s, c),
g AS (SELECT class, step, count(*) AS n, count(*) FILTER (hit) AS k FROM r, (SELECT unnest(range(5, 100)) AS step) WHERE bin >= step GROUP BY class, step),
b AS (SELECT class, min(step) AS step FROM g WHERE k >= 0.9 * n GROUP BY class), a AS (SELECT class, count(*) FILTER (hit) AS allk FROM r GROUP BY class)
SELECT a.class, coalesce(round(b.step / 100.0, 2), 1.01) AS threshold, coalesce(round(g.k / g.n, 6), 0) AS prec, coalesce(round(g.k / greatest(allk, 1), 6), 0) AS recall
FROM a LEFT JOIN b ON a.class = b.class LEFT JOIN g ON g.class = a.class AND g.step = b.step""")
def _(spark, d):
    return classify.calibrated(_scored(spark, d), "quality", [0, 1], {0: 1 - F.col("s"), 1: F.col("s")}, 0.9)


@add("m6_threshold_curve", f"""
WITH s AS (SELECT quality = 1 AS y, CAST({SCORE_SQL} AS DOUBLE) AS s FROM labels)
SELECT threshold, round(count(*) FILTER (s >= threshold AND y) / nullif(count(*) FILTER (s >= threshold), 0), 6) AS prec, round(count(*) FILTER (s >= threshold AND y) / nullif(count(*) FILTER (y), 0), 6) AS recall,
  round(count(*) FILTER (s >= threshold AND NOT y) / nullif(count(*) FILTER (NOT y), 0), 6) AS false_positive FROM s, (SELECT CAST(unnest([{', '.join(map(str, classify.CURVE))}]) AS DOUBLE) AS threshold) GROUP BY threshold""")
def _(spark, d):
    return classify.threshold_curve(_scored(spark, d), "quality", F.col("s"))


@add("m2_m5_classifier")
def _(spark, d):
    """Train on two thirds of the labelled documents, calibrate, abstain; rows with their decision."""
    df = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    with Tables(spark) as tables:
        rows = classify.counted_once(tables, df, "text", "doc_id", "label")
        model = classify.train_counted(rows.where("doc_id % 3 <> 0"), iterations=10)
        scored = tables.kept(classify.probabilities(model, rows.where("doc_id % 3 = 0")).select("doc_id", "label", "p"), "scored")
    thresholds = {r["class"]: r["threshold"] for r in classify.calibrated(scored, "label", [0, 1]).collect()}
    return scored.select("doc_id", "label", F.round(F.col("p")[1], 6).alias("score"), classify.decided(F.col("p"), [0, 1], thresholds).cast("int").alias("decision"))


@add("m6_leave_one_out")
def _(spark, d):
    """False positives with each language left out of training."""
    df = t(spark, d, "documents").select("doc_id", "text", "lang").join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return classify.leave_one_out(df, "lang", hashed=True, iterations=10)


@add("l14_audit", """
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem WHERE l_linenumber <= 4), c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem WHERE l_linenumber >= 2),
b AS (SELECT coalesce(s.k, c.k) AS k, count(s.f) AS ns, count(c.f) AS nc, count(*) FILTER (s.f IS NOT NULL AND c.f IS NOT NULL) AS p FROM s FULL JOIN c ON s.k = c.k AND s.f = c.f GROUP BY 1)
SELECT count(*) AS documents, CAST(sum(ns) AS BIGINT) AS equations, round(sum(p) / sum(ns), 6) AS preserved_rate, round(sum(greatest(0, ns - nc)) / sum(ns), 6) AS absent_rate,
  round(sum(greatest(0, least(ns, nc) - p)) / sum(ns), 6) AS discordant_rate FROM b WHERE ns > 0""")
def _(spark, d):
    sets = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("form"), "l_linenumber")
    return audit.audit_summary(audit.compare(sets.where("l_linenumber <= 4"), sets.where("l_linenumber >= 2"), "k"))


_STEPS, _term, _total = [], 2.718281828459045**-1, 0.0
for _k in range(8):
    _total += _term
    _STEPS.append(_total)
    _term /= _k + 1


@add("l15_bootstrap", f"""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS p, 1 AS w FROM orders),
u AS (SELECT b, p, w, CAST(('0x' || substr(md5('17|' || CAST(b AS VARCHAR) || '|' || CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM r, (SELECT unnest(range(1, 1001)) AS b)),
x AS (SELECT b, p, w, {' + '.join(f'CAST(u >= CAST({s!r} AS DOUBLE) AS INTEGER)' for s in _STEPS)} AS n FROM (SELECT b, p, w, CAST(u AS DOUBLE) AS u FROM u)),
s AS (SELECT b, sum(n * p) / sum(n * w) AS r FROM x GROUP BY b)
SELECT (SELECT count(*) FROM r) AS documents, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM s""")
def _(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("p"), F.lit(1).alias("w"))
    return audit.bootstrap_ratio(rows, "k", "p", "w")


SOURCES = [
    (1, r"\newcommand{\E}{\mathcal{E}} \begin{equation} \E = m c^{2} \label{a} \end{equation} % $x=1$" + "\n" + r"and $a \le b$ so \[ \dfrac{1}{2} \]"),
    (2, r"$E_{\rm cin} = \tfrac12 m v_{0}^2$ and $\mathbf{A} \cdot \mathbf{B} = c$"),
    (3, None),
    (4, "no mathematics"),
]


EQUATIONS = [
    (1, 0, r"\mathcal{E} = m c^{2} \label{a}", r"\mathcal{E}=mc^2", r"\mathcal{E} = m c^{2} \label{a}"), (1, 1, r"\dfrac{1}{2}", r"\frac{1}{2}", r"\dfrac{1}{2}"), (1, 2, r"a \le b", r"a\leq b", r"a \le b"),
    (2, 0, r"E_{\rm cin} = \tfrac12 m v_{0}^2", r"E_{\rm cin}=\frac12mv_0^2", r"E_cin = \tfrac12 m v_0^2"), (2, 1, r"\mathbf{A} \cdot \mathbf{B} = c", r"\mathbf{A}\cdot\mathbf{B}=c", r"\mathbf{A} \cdot \mathbf{B} = c"),
]


#: The SQL states the rows that the sources must give.
@add("l1_l8_equations", f"SELECT * FROM {values(EQUATIONS, 'id, \"at\", eq, form, named')}")
def _(spark, d):
    df = spark.createDataFrame(SOURCES, "id int, tex string")
    eqs = df.select("id", F.posexplode(latex.equations_of("tex")).alias("at", "eq"))
    return eqs.select("id", "at", "eq", latex.canonical_of("eq").alias("form"), latex.identifiers_of("eq").alias("named"))


@add("l1_comments", r"SELECT doc_id, sha256(regexp_replace(text, '([^\\%]+|\\.)|%[^\n]*', '\1', 'gs')) AS h FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(latex.comments_removed(F.col("text")), 256).alias("h"))


BUNDLES = [(1, {"main.tex": r"\documentclass{a}\begin{document}\input{b}\input gone $x+y=1$\end{document} tail", "b.tex": r"$a=b+c$", "old.tex": "$q=1$"}), (2, {"x.tex": "$a=b$", "y.tex": "text"})]
ASSEMBLED = [(1, "\\documentclass{a}\\begin{document}\n$a=b+c$\n $x+y=1$", "assembled", "main.tex", "b.tex", "gone", "old.tex"), (2, "$a=b$\ntext", "concatenated", None, "", "", "")]


@add("l4_assembled", f"SELECT * FROM {values(ASSEMBLED, 'id, text, mode, main, included, missing, ignored')}")
def _(spark, d):
    df = spark.createDataFrame(BUNDLES, "id int, files map<string,string>").select("id", latex.assembled_of("files").alias("r"))
    return df.select("id", "r.text", "r.mode", "r.main", *[F.array_join(f"r.{c}", ",").alias(c) for c in ("included", "missing", "ignored")])


RESULTS = [
    (1, 0, "pass", 0.99), (1, 1, "pass", 0.9), (1, 2, "inconclusive", 0.0), (2, 0, "pass", 0.9), (2, 1, "fail", 0.95), (3, 0, "error", 0.0), (3, 1, "inconclusive", 0.0), (4, 0, "fail", 0.5),
    (4, 1, "fail", 0.95), (4, 2, "error", 0.0), (5, 0, "inconclusive", 0.0), (6, 0, "pass", 0.8), (6, 1, "error", 0.0), (6, 2, "inconclusive", 0.0), (6, 3, "inconclusive", 0.0), (6, 4, "inconclusive", 0.0), (6, 5, "inconclusive", 0.0),
]


@add("v1_v2_combined", f"""
WITH r AS (SELECT * FROM {values(RESULTS, 'claim_id, ord, verdict, confidence')}),
g AS (SELECT claim_id, count(*) FILTER (verdict = 'pass') AS p, count(*) FILTER (verdict = 'fail') AS f, count(*) FILTER (verdict = 'inconclusive') AS i, count(*) FILTER (verdict = 'error') AS e,
  min(confidence) FILTER (verdict = 'pass') AS least, coalesce(arg_min(confidence, ord) FILTER (verdict = 'fail' AND confidence >= 0.9), arg_min(confidence, ord) FILTER (verdict = 'fail')) AS failing FROM r GROUP BY claim_id),
v AS (SELECT claim_id, CASE WHEN f > 0 AND p > 0 THEN 'error' WHEN f > 0 THEN 'fail' WHEN p > 0 THEN 'pass' WHEN e > 0 THEN 'error' ELSE 'inconclusive' END AS verdict,
  CAST(CASE WHEN f > 0 AND p > 0 THEN 0 WHEN f > 0 THEN failing WHEN p > 0 THEN round(least * (1 - 0.15 * least(i, 3)), 3) ELSE 0 END AS DOUBLE) AS confidence FROM g)
SELECT claim_id, verdict, confidence, CASE verdict WHEN 'pass' THEN confidence WHEN 'fail' THEN -confidence ELSE 0 END AS reward FROM v""")
def _(spark, d):
    out = verify.combined(spark.createDataFrame(RESULTS, "claim_id int, ord int, verdict string, confidence double"))
    return out.withColumn("reward", verify.reward(F.col("verdict"), F.col("confidence")))


REACTIONS = [
    (1, ["n"], ["p", "e-", "nu_e_bar"]), (2, ["n"], ["p", "e-"]), (3, ["mu-"], ["e-", "nu_e_bar", "nu_mu"]), (4, ["e+", "e-"], ["2gamma"]), (5, ["p"], ["e+", "pi0"]),
    (6, ["92:235", "n"], ["56:141", "36:92", "n", "n", "n"]), (7, ["X"], ["p"]), (8, [], ["p"]), (9, ["pi+"], ["mu+", "nu_mu"]),
]


@add("v9_conserved", f"""
WITH t AS (SELECT * FROM {values(verify.PARTICLES, 'particle, q, b, le, lmu, ltau')}), r AS (SELECT * FROM {values(REACTIONS, 'claim_id, before, after')}),
x AS (SELECT claim_id, -1 AS s, unnest(before) AS nm FROM r UNION ALL SELECT claim_id, 1, unnest(after) FROM r),
y AS (SELECT claim_id, s, CASE WHEN regexp_matches(nm, '^[1-9][^0-9]') AND NOT contains(nm, ':') THEN CAST(substr(nm, 1, 1) AS INTEGER) ELSE 1 END AS k, CASE WHEN regexp_matches(nm, '^[1-9][^0-9]') AND NOT contains(nm, ':') THEN substr(nm, 2) ELSE nm END AS p FROM x),
z AS (SELECT claim_id, s, k, coalesce(q, TRY_CAST(split_part(p, ':', 1) AS INTEGER)) AS q, coalesce(b, TRY_CAST(nullif(split_part(p, ':', 2), '') AS INTEGER)) AS b, coalesce(le, 0) AS le, coalesce(lmu, 0) AS lmu, coalesce(ltau, 0) AS ltau FROM y LEFT JOIN t ON t.particle = y.p),
g AS (SELECT claim_id, count(*) FILTER (b IS NULL OR q IS NULL) AS un, count(*) FILTER (s < 0) AS nb, count(*) FILTER (s > 0) AS na, sum(s*k*q) AS dq, sum(s*k*b) AS db, sum(s*k*le) AS d1, sum(s*k*lmu) AS d2, sum(s*k*ltau) AS d3 FROM z GROUP BY claim_id)
SELECT claim_id, CASE WHEN un > 0 OR nb = 0 OR na = 0 THEN 'inconclusive' WHEN dq = 0 AND db = 0 AND d1 = 0 AND d2 = 0 AND d3 = 0 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN un > 0 OR nb = 0 OR na = 0 THEN 0.0 ELSE 1.0 END AS confidence FROM g""")
def _(spark, d):
    return verify.conserved(spark.createDataFrame(REACTIONS, "claim_id int, before array<string>, after array<string>"))


CLAIMS = [
    (1, "(x+1)^2", "x^2 + 2*x + 1", None), (2, "(x+1)^2", "x^2 + 1", None), (3, r"\frac{1}{2} m v^2", "W", '{"unit_system": "SI"}'), (4, "m a", "F", '{"unit_system": "SI"}'),
    (5, "sin(x)^2 + cos(x)^2", "1", None), (6, "E", "m c^2", '{"unit_system": "SI"}'), (7, "((", "1", None), (8, r"\hat{A} \hat{B}", r"\hat{B} \hat{A}", None),
    (9, "sqrt(1 + v^2) - 1", None, '{"limit": {"var": "v", "to": 0, "expected": "v^2/2", "mode": "dominante"}}'), (10, "q^2 + w^2", None, '{"conserved": {"quantity": "r", "solution": {"q": "cos(t)", "w": "sin(t)"}}}'),
]


@add("v3_v10_claims")
def _(spark, d):
    return verify.check_claims(spark.createDataFrame(CLAIMS, "claim_id int, lhs string, rhs string, context string"))


FILES_OLD = [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None), ("d", 4, "w")]
FILES_NEW = [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "q"), ("e", 1, "k")]


@add("h5_divergences", f"""
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'absent' WHEN o.path IS NULL THEN 'extra' ELSE 'altered' END AS kind
FROM {values(FILES_OLD, 'path, size, h').replace('AS v(', 'AS o(')} FULL JOIN {values(FILES_NEW, 'path, size, h').replace('AS v(', 'AS n(')} ON o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR coalesce(o.h <> n.h, false)""")
def _(spark, d):
    schema = "path string, size long, sha256 string"
    return lineage.divergences(spark.createDataFrame(FILES_OLD, schema), spark.createDataFrame(FILES_NEW, schema))


@add("h4_index_root", """
WITH l AS (SELECT source AS path, count(*) AS size, sha256(source) AS h FROM documents GROUP BY source),
g AS (SELECT substr(md5(path), 1, 3) AS g, sha256(string_agg(x, chr(10) ORDER BY x)) AS h, sum(size) AS b, count(*) AS n FROM (SELECT path, size, sha256(path || '|' || CAST(size AS VARCHAR) || '|' || h) AS x FROM l) GROUP BY 1)
SELECT sha256(string_agg(g || h, chr(10) ORDER BY g)) AS root, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM g""")
def _(spark, d):
    index = t(spark, d, "documents").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("size")).withColumn("sha256", F.sha2("path", 256))
    return lineage.index_root(index)


@add("s15_stream_resume", "SELECT source, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY source")
def _(spark, d):
    """The documents file as a stream, filtered, resumed once; a second run must add nothing."""
    folder = new_path(spark, "stream")
    df = t(spark, d, "documents")
    df.select("doc_id", "source", "n_chars").write.parquet(f"{folder}/in")
    step = lambda s: s.where("n_chars >= 500")
    for _ in range(2):
        incremental.process_new_files(spark, f"{folder}/in", "doc_id long, source string, n_chars long", f"{folder}/out", f"{folder}/ck", step, 4)
    return spark.read.parquet(f"{folder}/out").groupBy("source").agg(F.count("*").alias("n"))


@add("x1_windowed_counts", "SELECT date_trunc('hour', ts) AS w_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """Event-time windows; not a parity item."""
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(events).withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))


@add("r2_mining_statistics", """
WITH k AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS cand FROM lineitem WHERE l_linenumber <= 5), c AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS cand FROM lineitem WHERE l_linenumber >= 3),
n AS (SELECT k.* FROM k WHERE k.src <> k.cand AND NOT EXISTS (SELECT 1 FROM c WHERE c.src = k.src AND c.cand = k.cand)), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cand DESC) AS rn FROM n)
SELECT (SELECT count(*) FROM k) AS candidates, (SELECT count(*) FROM r WHERE rn <= 2) AS kept, (SELECT count(DISTINCT src) FROM k WHERE src NOT IN (SELECT src FROM r)) AS without_negative,
  (SELECT count(*) FROM k) - (SELECT count(*) FROM r WHERE rn <= 2) AS dropped""")
def _(spark, d):
    lines = t(spark, d, "lineitem")
    candidates = lines.where("l_linenumber <= 5").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("cand")).distinct().withColumn("score", F.col("cand"))
    edges = lines.where("l_linenumber >= 3").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    kept = graph.exclude_cited(candidates, edges, "src", "cand", "dst", "score", 2)
    return graph.negative_statistics(candidates, kept, candidates, "src")


@add("j13_negative_texts", """
WITH r AS (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS INTEGER) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rank) AS ids, sha256(string_agg(p_name, '|' ORDER BY rank)) AS names FROM r JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def _(spark, d):
    from pyspark.sql import Window

    pairs = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")))
    out = graph.attach_texts(ranked, t(spark, d, "part"), "l_orderkey", "l_partkey", "p_partkey", "p_name")
    ids = F.array_join(F.transform("negative_ids", lambda x: x.cast("string")), ",")
    return out.select("l_orderkey", ids.alias("ids"), F.sha2(F.array_join("negatives", "|"), 256).alias("names"))


@add("d8_a12_cluster_sizes", f"""
WITH RECURSIVE {SIGNED}, l AS (SELECT a, b FROM e WHERE estimate >= 0.85 UNION ALL SELECT b, a FROM e WHERE estimate >= 0.85),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT root, count(*) AS members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, (SELECT count(*) FROM e) AS pairs_scored FROM m GROUP BY root""")
def _(spark, d):
    sigs = dedup.cut(dedup.signatures(t(spark, d, "documents"), "doc_id", "text"))
    classes, pairs = dedup.class_pairs(sigs, "doc_id")
    members = dedup.clusters(dedup.class_links(classes, pairs.where(F.col("equal") / F.lit(float(dedup.N_PERM)) >= 0.85), "doc_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return members.groupBy("root").agg(F.count("*").alias("members"), ids.alias("ids")).join(F.broadcast(dedup.pair_count(classes, pairs)))


@add("a8_host_yield", """
SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, count(*) AS seen, count(*) FILTER (length(html) >= 2000) AS accepted, round(avg(CASE WHEN length(html) >= 2000 THEN 1 ELSE 0 END), 6) AS rate,
  CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""")
def _(spark, d):
    from ..functions.text import host

    ok = F.length("html") >= 2000
    return t(spark, d, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("seen"), F.count_if(ok).alias("accepted"), F.round(F.avg(ok.cast("int")), 6).alias("rate"), F.sum(F.length("html").cast("long")).alias("chars"))
