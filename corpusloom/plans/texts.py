"""Scalar and text operators, licenses, taxonomy and works, on the driver's tables and on fixed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import licensing, taxonomy, text, works
from ..operators import spine
from ._base import Book, quoted, t, values

BOOK = Book()
add = BOOK.add

NORM = r"trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))"

LICENSES = [
    (1, "http://creativecommons.org/licenses/by/4.0/"), (2, "http://creativecommons.org/licenses/by-nc-sa/4.0/"), (3, "http://creativecommons.org/licenses/by-nc/3.0/"),
    (4, "HTTP://CREATIVECOMMONS.ORG/licenses/BY-SA/4.0/"), (5, "http://creativecommons.org/publicdomain/zero/1.0/"), (6, "http://arxiv.org/licenses/nonexclusive-distrib/1.0/"),
    (7, None), (8, ""), (9, "all rights reserved"), (10, "http://creativecommons.org/licenses/by-nc-nd/4.0/"), (11, "arXiv-perpetual-nonexclusive"), (12, "http://creativecommons.org/licenses/by"),
]


def _case(column: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({column}), {quoted(p)}) THEN {quoted(k)}" for p, k in licensing.RULES)
    return f"CASE WHEN {column} IS NULL OR {column} = '' THEN {quoted(licensing.DEFAULT)} {rules} ELSE {quoted(licensing.UNKNOWN)} END"


def _lookup(column: str, mapping: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" ELSE {other} END"


SPDX = {r[0]: r[1] for r in licensing.CATALOG}
PARTS = {r[0]: licensing.partition_of(r[2], r[3]) for r in licensing.CATALOG}


@add("p1_license_keys", f"""
SELECT id, k AS license_key, {_lookup('k', SPDX, 'NULL')} AS spdx_id, {_lookup('k', PARTS, 'NULL')} AS "partition"
FROM (SELECT id, {_case('raw')} AS k FROM {values(LICENSES, 'id, raw')})""")
def _(spark, d):
    df = spark.createDataFrame(LICENSES, "id int, raw string")
    return df.select("id", licensing.license_key(F.col("raw")).alias("license_key"), licensing.spdx_id(F.col("raw")).alias("spdx_id"), licensing.partition(F.col("raw")).alias("partition"))


LINE_SQL = "CASE WHEN contains(lower(text), 'mit license') THEN 'http://creativecommons.org/licenses/by/4.0/' WHEN contains(lower(text), 'apache license') THEN 'http://creativecommons.org/licenses/by-nc-sa/4.0/' WHEN contains(lower(text), 'gnu general') THEN 'other' END"


@add("p2_route_documents", f"""
SELECT {_lookup('k', PARTS, 'NULL')} AS "partition", count(*) AS n FROM (SELECT {_case('raw')} AS k FROM (SELECT {LINE_SQL} AS raw FROM documents)) GROUP BY 1""")
def _(spark, d):
    low = F.lower("text")
    raw = F.when(low.contains("mit license"), "http://creativecommons.org/licenses/by/4.0/").when(low.contains("apache license"), "http://creativecommons.org/licenses/by-nc-sa/4.0/").when(low.contains("gnu general"), "other")
    df = t(spark, d, "documents").select(licensing.partition(raw).alias("partition"))
    return df.groupBy("partition").agg(F.count("*").alias("n"))


PAPERS = [
    (1, ["cond-mat.str-el", "math.AP"], "2004-01-02", "PRL 1"), (2, ["chao-dyn"], "1995", None), (3, ["math.AP"], "abcd", None), (4, ["cs.LG", "hep-th"], None, "J"), (5, ["q-alg", "math.AP"], "1996-05-05", None),
    (6, ["mtrl-th", "cond-mat"], "1994-01-01", None), (7, ["funct-an"], "1997-01-01", None), (8, ["physics.optics"], "2020-12-31", "X"),
]


@add("p3_p8_taxonomy", f"""
WITH p AS (SELECT id, cats, cats[1] AS prim, created, journal_ref FROM {values(PAPERS, 'id, cats, created, journal_ref')}),
a AS (SELECT *, {_lookup("split_part(prim, '.', 1)", taxonomy.LEGACY, "split_part(prim, '.', 1)")} AS archive,
      list_sort(list_distinct(list_transform(cats, lambda c: {_lookup("split_part(c, '.', 1)", taxonomy.LEGACY, "split_part(c, '.', 1)")}))) AS archives FROM p)
SELECT id, archive, array_to_string(archives, ',') AS archives,
  len(list_filter(archives, lambda x: x IN ({', '.join(map(quoted, taxonomy.SUBFIELDS))}))) > 0 AS is_physics,
  list_has_any(cats, [{', '.join(map(quoted, taxonomy.MATH_SUPPORT))}]) AS is_math_support,
  {_lookup('archive', taxonomy.SUBFIELDS, quoted(taxonomy.OTHER))} AS subfield, journal_ref IS NOT NULL AS peer_reviewed,
  TRY_CAST(substr(created, 1, 4) AS INTEGER) AS year,
  ({' OR '.join(f"starts_with(prim, {quoted(x)})" for x in taxonomy.SUBFIELDS)}) AS primary_physics FROM a""")
def _(spark, d):
    df = spark.createDataFrame(PAPERS, "id int, categories array<string>, created string, journal_ref string")
    df = df.withColumns({"primary_category": F.col("categories")[0], "license": F.lit(None).cast("string")})
    out = spine.annotate(df).withColumn("primary_physics", taxonomy.primary_has_prefix(F.col("primary_category")))
    return out.select("id", "archive", F.array_join("archives", ",").alias("archives"), "is_physics", "is_math_support", "subfield", "peer_reviewed", "year", "primary_physics")


@add("p9_classifier_text", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(source, '') || chr(10) || coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(text.classifier_text(F.col("source"), F.col("text")), 256).alias("h"))


@add("p10_pair_text", "SELECT doc_id, sha256(p) AS h FROM (SELECT doc_id, coalesce(source, '') || '. ' || coalesce(text, '') AS p FROM documents) WHERE length(p) >= 120")
def _(spark, d):
    out = t(spark, d, "documents").select("doc_id", text.pair_text(F.col("source"), F.col("text")).alias("p"))
    return out.where(F.length("p") >= 120).select("doc_id", F.sha2("p", 256).alias("h"))


@add("p17_hosts", "SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages WHERE starts_with(lower(url), 'http') GROUP BY 1")
def _(spark, d):
    return t(spark, d, "pages").select(text.host(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n"))


@add("p19_normal_form", f"SELECT doc_id, sha256({NORM}) AS h, length({NORM}) AS n FROM documents")
def _(spark, d):
    norm = text.normal_form(F.col("text"))
    return t(spark, d, "documents").select("doc_id", norm.alias("x")).select("doc_id", F.sha2("x", 256).alias("h"), F.length("x").alias("n"))


@add("p20_exact_keys", f"SELECT substr(sha256({NORM}), 1, 32) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    df = t(spark, d, "documents").select("doc_id", text.exact_key(F.col("text")).alias("k"))
    return df.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@add("p21_token_estimate", "SELECT lang, round(sum(length(text)) / 4.0, 2) AS tokens FROM documents GROUP BY lang")
def _(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.round(text.token_estimate(F.sum(F.length("text").cast("long"))), 2).alias("tokens"))


WORKS = [
    ("https://openalex.org/W1", "https://doi.org/10.1103/PhysRevD.1.1", ["https://example.org/x", "http://arxiv.org/abs/2203.07905"], ["https://openalex.org/W2", None, "https://openalex.org/W3"], 7),
    ("https://openalex.org/W2", "https://doi.org/10.48550/arXiv.1412.6980", [], [], 5),
    ("https://openalex.org/W3", None, ["https://arxiv.org/abs/1412.6980v5"], None, 0),
    ("https://openalex.org/W4", "", ["https://arxiv.org/abs/hep-th/9711200"], ["https://openalex.org/W1"], 9),
    ("https://openalex.org/W5", None, None, ["https://openalex.org/W9"], 1),
    (None, "10.1/x", ["https://pub.example/ARXIV"], [], None),
]
_ID_SQL = r"(?:[a-z][a-z-]*(?:\.[A-Za-z]{2})?/\d{7}|\d{4}\.\d{4,5})"


@add("p11_p14_works", f"""
WITH w AS (SELECT row_number() OVER () AS n, * FROM {values(WORKS, 'id, doi, urls, refs, cited')}),
x AS (SELECT *, nullif(regexp_extract(coalesce(doi, ''), '(?i)10\\.48550/arxiv\\.({_ID_SQL})', 1), '') AS by_doi,
  list_filter(list_transform(coalesce(urls, CAST([] AS VARCHAR[])), lambda u: nullif(regexp_extract(coalesce(u, ''), '(?i)arxiv\\.org/abs/({_ID_SQL})', 1), '')), lambda u: u IS NOT NULL) AS by_url FROM w)
SELECT split_part(id, '/', -1) AS openalex_id, coalesce(by_doi, by_url[1]) AS arxiv_id, nullif(replace(doi, 'https://doi.org/', ''), '') AS doi,
  CAST(len(coalesce(refs, CAST([] AS VARCHAR[]))) AS INTEGER) AS n_references,
  array_to_string(list_transform(list_filter(coalesce(refs, CAST([] AS VARCHAR[])), lambda r: r IS NOT NULL), lambda r: split_part(r, '/', -1)), ',') AS referenced,
  coalesce(contains(lower(doi), 'arxiv'), false) OR len(list_filter(coalesce(urls, CAST([] AS VARCHAR[])), lambda u: contains(lower(u), 'arxiv'))) > 0 AS maybe FROM x""")
def _(spark, d):
    rows = [(i, doi, None if urls is None else [(u, None) for u in urls], refs, cited) for i, doi, urls, refs, cited in WORKS]
    schema = "id string, doi string, locations array<struct<landing_page_url:string,source:struct<display_name:string>>>, referenced_works array<string>, cited_by_count int"
    df = spark.createDataFrame(rows, schema)
    for name in ("title string", "publication_year int", "publication_date date", "type string", "language string", "open_access struct<is_oa:boolean,oa_status:string>", "primary_topic struct<display_name:string,field:struct<display_name:string>>"):
        column, kind = name.split(" ", 1)
        df = df.withColumn(column, F.lit(None).cast(kind))
    df = df.withColumn("maybe", works.maybe_preprint(F.col("doi"), F.col("locations")))
    out = works.parse_works(df)
    flags = df.select(text.short_id(F.col("id")).alias("k"), "maybe")
    joined = out.join(flags, out["openalex_id"].eqNullSafe(flags["k"]))
    return joined.select("openalex_id", "arxiv_id", "doi", "n_references", F.array_join("referenced_works", ",").alias("referenced"), "maybe")
