import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import top_k
from corpusloom.llm.top_k import OP9_SQL, exact_top_k, op9_top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    v = {i: np.floor(np.array(x, dtype=np.float32).astype(float) * 256) for i, x, _ in rows}
    out = []
    for q in sorted(v):
        if q % every == 0:
            s = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["lengths", "ties", "low rank"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)) * (rng.pareto(1, size=(600, 1)) if kind == "lengths" else 1)
    if kind == "ties":
        x = np.round(x[:8])[rng.integers(0, 8, 600)]
    if kind == "low rank":
        x = x[:, :3] @ rng.normal(size=(3, 16))
    rows = [(i, [float(f) for f in r], 1) for i, r in enumerate(x)] + [(700, [1.0, 2.0], 1), (750, [1.0, -2.0], 1)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 50, 5)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (50, [0.0, 1.0], 1)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 32768), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, op9_top_k(spark, sf).collect())) == sorted(con.execute(OP9_SQL).fetchall())


@pytest.mark.parametrize("batch", ["40", "10000"])
def test_several_files_in_one_read_task(spark, monkeypatch, batch):
    """The files of the longest vectors are the smallest, so Spark reads them last; slices end at files' borders or straddle them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[::6] = 30 * np.round(x[rng.integers(0, 3, 100)])  # long and repeated: small files
    rows = [(i, [float(f) for f in r], 1) for i, r in enumerate(x)]
    monkeypatch.setattr(top_k, "PART_ROWS", 100)
    confs = {"spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {c: spark.conf.get(c, None) for c in confs}
    for c, value in confs.items():
        spark.conf.set(c, value)
    try:
        got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 50, 5)


def test_several_blocks_and_waves_with_repeated_ids(spark, monkeypatch):
    """Blocks of a few queries, in several jobs; rows whose id repeats are candidates each and queries each, but never each other's."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * rng.lognormal(size=(300, 1))
    rows = [(i % 250, [float(f) for f in np.float32(r)], 1) for i, r in enumerate(x)]
    for name, value in (("BLOCK", 2), ("WAVE", 2), ("PART_ROWS", 70)):
        monkeypatch.setattr(top_k, name, value)
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=3).collect()
    whole = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256)) for i, v, _ in rows]
    expected = []
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for c, w in whole if c != q)[:3]
            expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)


def test_empty_and_long_vectors(spark, monkeypatch):
    """Vectors without components score 0 with each other; long ones go in smaller blocks of queries."""
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 8 * 40 * 3)
    rng = np.random.default_rng(8)
    rows = [(i, [] if i % 7 == 0 else rng.normal(size=40).tolist(), "x") for i in range(60)]
    got = {tuple(r) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), F.col("vec_id") % 2 == 0).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    expected = set()
    for q in range(0, 60, 2):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
        expected |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])}
    assert got == expected
