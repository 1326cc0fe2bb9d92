"""Threshold join and semantic duplicates of vectors against brute force."""

import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import vectors as vc

ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [math.nan] + [1.0] * 15), (904, [math.inf] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (None, [1.0] * 16)]
SCHEMA = "vec_id long, embedding array<double>, v string"


def case(seed, n, d=16, copies=0, noise=0.05):
    """Random vectors of any length, and near copies of some."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x[rng.integers(0, n, copies)] + noise * rng.normal(size=(copies, d))
    out = np.concatenate([x, y]) * np.exp(rng.normal(size=(n + copies, 1)))
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(out)), out)]


def cosines(rows):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(x @ x.T, 6)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("threshold", "query_bytes"), [(0.3, 1 << 20), (0.9, 2000)])
def test_join_equals_all_pairs(spark, threshold, query_bytes):
    rows = case(1, 120, copies=40)
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], rows[9][1])]  # repeated ids
    asked = [r for r in rows if r[0] % 5 == 0]
    got = vc.similarity_join(frame(spark, asked + ODD), frame(spark, rows + ODD), threshold, "vec_id", "embedding", query_bytes=query_bytes).collect()
    score = cosines(asked + rows)[: len(asked), len(asked) :]
    expected = [(q, c, float(score[i, j])) for i, (q, _) in enumerate(asked) for j, (c, _) in enumerate(rows) if q != c and score[i, j] >= threshold]
    assert sorted(map(tuple, got)) == sorted(expected) and len(got) > 10


def test_the_bound_skips_most_pairs_and_loses_none(spark):
    """Vectors along few directions: the first components decide."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 32)) + 0.01 * rng.normal(size=(400, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    basis, held = vc.rotation(vc.usable(frame(spark, rows), "vec_id", "embedding"), 300)
    assert held < 5 and np.allclose(basis @ basis.T, np.eye(32))
    got = vc.similarity_join(frame(spark, rows[::20]), frame(spark, rows), 0.95, "vec_id", "embedding").collect()
    score = cosines(rows)
    assert {(r.query, r.candidate) for r in got} == {(i, j) for i in range(0, 400, 20) for j in range(400) if i != j and score[i, j] >= 0.95}


def test_contamination_rows(spark):
    rows = case(3, 100, copies=50)
    asked = [(i, v) for i, v in rows if i % 10 == 0]
    got = {r.vec_id: r for r in vc.contamination(frame(spark, rows + ODD), frame(spark, asked), 0.8, "vec_id", "embedding").collect()}
    score = cosines(rows)
    for j, (c, _) in enumerate(rows):
        hits = [(score[i, j], -q) for i, (q, _) in enumerate(rows) if q % 10 == 0 and q != c and score[i, j] >= 0.8]
        r = got[c]
        assert (r.n_items, r.contaminated) == (len(hits), bool(hits))
        assert (r.best_score, r.best_item) == ((pytest.approx(max(hits)[0]), -max(hits)[1]) if hits else (None, None))
    assert all(got[i].n_items == 0 for i, _ in ODD if i) and None not in got
    empty = frame(spark, []).limit(0)
    assert vc.contamination(frame(spark, rows), empty, 0.8, "vec_id", "embedding").where("contaminated").count() == 0
    assert vc.similarity_join(empty, empty, 0.8, "vec_id", "embedding").count() == 0


def brute(rows, threshold, cells=None, centres=None):
    """Ids that go: some row of smaller id is similar, anywhere or in the cells that a row is compared in."""
    score = cosines(rows)
    ids = np.array([i for i, _ in rows])
    hit = (score >= threshold) & (ids[None] < ids[:, None])
    if centres is not None:
        x = np.array([v for _, v in rows])
        near = np.argsort(-(x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T, axis=1, kind="stable")[:, :cells]
        hit &= (near[:, :, None] == near[None, :, 0].T.reshape(1, 1, -1)).any(axis=1)
    return {int(i) for i in ids[hit.any(axis=1)]}, {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(hit))}


@pytest.mark.parametrize(("cells", "block_bytes"), [(1, 1 << 20), (6, 1 << 20), (6, 20 * 8 * 16)])
def test_duplicates_equal_brute_force_inside_cells(spark, monkeypatch, cells, block_bytes):
    rows = case(4, 250, copies=250)
    kept = {}
    fit = vc.spherical_k_means
    monkeypatch.setattr(vc, "spherical_k_means", lambda *a: kept.setdefault("c", fit(*a)))
    got = vc.semantic_duplicates(frame(spark, rows + ODD), "vec_id", "embedding", 0.9, cells=cells, block_bytes=block_bytes).collect()
    gone, pairs = brute(rows, 0.9, vc.PROBES, kept["c"])
    assert {r.id for r in got if not r.kept} == gone and len(gone) > 150
    assert all((r.id, r.witness) in pairs for r in got if not r.kept)
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows + ODD if i is not None) and all(r.kept for r in got if r.id >= 900)


def test_recall_of_near_copies(spark):
    rows = case(5, 3000, d=32, copies=1500, noise=0.12)
    got = {r.id for r in vc.semantic_duplicates(frame(spark, rows), "vec_id", "embedding", 0.9, cells=8).collect() if not r.kept}
    gone, _ = brute(rows, 0.9)
    assert got <= gone and len(got) >= 0.9 * len(gone) > 500


def test_a_crowded_cell_is_settled_by_its_pivots(spark, monkeypatch):
    """Half of all rows are near copies of one vector: no row of theirs but the first is left to compare."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=16)
    rows = [(i, (one + 0.02 * rng.normal(size=16)).tolist()) for i in range(600)] + [(i + 600, rng.normal(size=16).tolist()) for i in range(600)]
    monkeypatch.setattr(vc, "CROWDED", 2)
    monkeypatch.setattr(vc, "SHARE", 10)
    got = vc.semantic_duplicates(frame(spark, rows), "vec_id", "embedding", 0.9, cells=5, block_bytes=50 * 8 * 16).collect()
    assert {r.id for r in got if not r.kept} >= set(range(1, 600)) and all(r.witness == 0 for r in got if 0 < r.id < 600)
    assert len({r.id for r in got if not r.kept} - set(range(600))) <= 5


def test_k_means_sums_equal_one_pass(spark):
    rows = case(7, 300)
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    start = vc.spherical_k_means(vc.usable(frame(spark, rows), "vec_id", "embedding").repartition(5), 7, 0)
    once = vc.spherical_k_means(vc.usable(frame(spark, rows), "vec_id", "embedding").repartition(5), 7, 1)
    own = (x @ start.T).argmax(axis=1)
    for c in range(7):
        total = x[own == c].sum(axis=0)
        assert np.allclose(once[c], total / np.linalg.norm(total))


def test_tables_without_usable_rows(spark):
    got = vc.semantic_duplicates(frame(spark, ODD[:6]), "vec_id", "embedding").collect()
    assert all(r.kept for r in got) and len(got) == 6


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query over a table with near copies, one of which a third of all rows repeat."""
    from corpusloom.plans import registry

    rows = case(9, 200, d=24, copies=100, noise=0.03)
    rng = np.random.default_rng(10)
    rows += [(i + 1000, (np.array(rows[0][1]) + 0.02 * rng.normal(size=24) * np.linalg.norm(rows[0][1]) / 5).tolist()) for i in range(150)]
    frame(spark, rows + ODD[:6]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["d11_semantic_duplicates"](spark, str(tmp_path)).collect()
    gone, pairs = brute(rows, 0.9)  # one cell: all pairs
    assert {r.id for r in got if not r.kept} == gone and len(gone) > 200 and all((r.id, r.witness) in pairs for r in got if not r.kept)


def test_many_queries_take_little_memory():
    """A block of queries meets rows tile by tile: the products never are as many as queries times rows."""
    rng = np.random.default_rng(3)
    own, x = rng.normal(size=(20_000, 8)), rng.normal(size=(512, 8))
    own, x = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (own, x))
    shared = SimpleNamespace(value=(np.arange(20_000), own, np.sqrt((own[:, 4:] ** 2).sum(axis=1)), np.eye(8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(512) + 19_900), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    got = {(q, c) for part in vc.reaching(shared, 4, 0.95)([batch]) for q, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, c = np.nonzero(np.round(own @ x.T, 6) >= 0.95)
    assert got == {(a, b + 19_900) for a, b in zip(q.tolist(), c.tolist(), strict=True) if a != b + 19_900} and peak < 60 << 20
