"""Every registered query of the library against its SQL, on the smallest tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from corpusloom.operators import audit
from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()
SLOW = {"d4_d6_scored_pairs", "d5_skipped_buckets", "d7_clusters", "d8_a12_cluster_sizes"}  # their SQL is slow; d3 has the same signatures


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def flat(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 5)
        return tuple(map(one, x)) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(expected.fetchall(), columns)


@pytest.mark.parametrize("name", ["m6_leave_one_out", "v3_v10_claims"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_bootstrap_of_all_orders_equals_brute_force(spark, sf, duck):
    orders = duck.execute("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) FROM orders").fetchall()
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    own, rates = np.array([p for _, p in orders]), []
    for b in range(1, 1001):
        u = np.array([int(hashlib.md5(f"17|{b}|{k}".encode()).hexdigest()[:8], 16) for k, _ in orders]) / 2.0**32
        n = np.searchsorted(steps, u, side="right")
        rates.append((n * own).sum() / n.sum())
    row = registry.queries()["l15_bootstrap"](spark, sf).first()
    assert row.documents == len(orders)
    assert (row.lo, row.hi) == pytest.approx(tuple(np.quantile(rates, [0.025, 0.975])), abs=2e-6)


def test_bootstrap_of_odd_keys_equals_brute_force(spark):
    """Keys of all lengths, hashed in arrays; a document without a key counts and is not drawn, as in the SQL. No row is written out for each resample."""
    keys = [str(k) for k in range(95, 140)] + ["é", "", "x" * 43, "x" * 55, "y" * 64, "z" * 200, "17|3"]
    rows = [(k, i % 3, 1 + i % 2) for i, k in enumerate(keys)]
    df = spark.createDataFrame([*rows, (None, 5, 5)], "k string, p int, w int")
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    p, w, rates = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), []
    for b in range(1, 121):
        u = np.array([int(hashlib.md5(f"17|{b}|{k}".encode()).hexdigest()[:8], 16) for k in keys]) / 2.0**32
        n = np.searchsorted(steps, u, side="right")
        rates.append((n * p).sum() / (n * w).sum())
    out = audit.bootstrap_ratio(df, "k", "p", "w", 120)
    row = out.first()
    assert row.documents == len(rows) + 1 and (row.lo, row.hi) == pytest.approx(tuple(np.quantile(rates, [0.025, 0.975])), abs=2e-6)
    assert "Generate" not in out._jdf.queryExecution().toString()


TEXTS = ["% whole line\nkept", "a % b\n% c\nd %% e", r"50\% of it % gone", "\\\\% gone", r"\\\% kept % gone", "no sign", "", None, "tab\x0bthen\x0b \n end ", "x\x1cy\x1fz"]


def without_comments(text):
    """Character by character: a percent sign after an even run of backslashes ends the line."""
    out, slashes, skip = [], 0, False
    for c in text:
        skip = skip and c != "\n" or c == "%" and slashes % 2 == 0
        slashes = slashes + 1 if c == "\\" and not skip else 0
        if not skip:
            out.append(c)
    return "".join(out)


def digest(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def documents(spark, duck, tmp_path):
    rows = duck.execute("SELECT doc_id, source, text FROM documents").fetchall()
    rows += [(1_000_000 + i, "src", x) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


@pytest.mark.parametrize("name", ["l1_comments", "p9_classifier_text", "p10_pair_text"])
def test_odd_texts_equal_the_sql(spark, documents, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents[0]}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.h for r in registry.queries()[name](spark, documents[0]).collect()}
    assert got == dict(con.execute(SQL[name]).fetchall())


def test_comments_of_all_documents(spark, documents):
    got = {r.doc_id: r.h for r in registry.queries()["l1_comments"](spark, documents[0]).collect()}
    assert got == {i: digest(None if x is None else without_comments(x)) for i, _, x in documents[1]}


def test_classifier_text_of_all_documents(spark, documents):
    got = {r.doc_id: r.h for r in registry.queries()["p9_classifier_text"](spark, documents[0]).collect()}
    assert got == {i: digest(re.sub(r"[ \t\n\x0b\f\r]+", " ", f"{s or ''}\n{x or ''}").strip(" ")) for i, s, x in documents[1]}


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
