"""The modified Huber classifier: features, distributed gradient, optimiser, held-out precision."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import huber


def test_grams_have_no_accents():
    assert huber.grams("Élan VITAL, a cœur ﬁn été") == ["elan", "vital", "cœur", "fin", "ete", "elan vital", "vital cœur", "cœur fin", "fin ete"]
    assert huber.grams(None) == huber.grams("a b .") == []


def test_loss_and_derivative():
    m = np.linspace(-3, 2, 1001)
    loss, slope = huber.loss_of(m)
    assert loss == pytest.approx([max(0, 1 - x) ** 2 if x >= -1 else -4 * x for x in m])
    assert slope[1:-1] == pytest.approx((loss[2:] - loss[:-2]) / (m[2:] - m[:-2]), abs=0.02)


def texts(n, seed, classes=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice([f"word{rng.randrange(30)}", f"class{i % classes}x{rng.randrange(5)}"]) for _ in range(rng.randrange(1, 20))), i % classes) for i in range(n)]


@pytest.mark.parametrize("classes", [2, 3])
def test_gradient_equals_brute_force(spark, classes):
    """Row by row with dictionaries, on five partitions."""
    rows = texts(60, 1, classes) + [(900, None, 0), (901, "", 1), (902, "one", None), (903, "two", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    bits, alpha = 10, 0.01
    kept = {}
    inner = huber.minimised
    huber.minimised = lambda of, w, steps: kept.setdefault("g", (of(kept.setdefault("w", np.random.default_rng(3).normal(size=w.shape))))) and w
    try:
        model = huber.train(df, classes=classes, alpha=alpha, bits=bits)
    finally:
        huber.minimised = inner
    used = [(t or "", y) for _, t, y in rows if y is not None and y < classes]
    counts = [{} for _ in used]
    for c, (t, _) in zip(counts, used, strict=True):
        for g in huber.grams(t):
            k = int(huber.hashed([g], bits)[0])
            c[k] = c.get(k, 0) + 1
    df_of = {k: sum(k in c for c in counts) for c in counts for k in c}
    idf = {k: math.log((1 + len(used)) / (1 + n)) + 1 if n >= 3 else 0.0 for k, n in df_of.items()}
    assert {k: model.idf[k] for k in df_of} == pytest.approx(idf)
    w, size = kept["w"], {y: sum(z == y for _, z in used) for y in range(classes)}
    loss, grad = alpha / 2 * (w[:, :-1] ** 2).sum(), alpha * w
    grad[:, -1] = 0
    for c, (_, y) in zip(counts, used, strict=True):
        x = {k: (1 + math.log(n)) * idf[k] for k, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        for k in range(len(w)):
            sign = 1 if y == (k if len(w) > 1 else 1) else -1
            m = sign * (sum(v / norm * w[k, i] for i, v in x.items()) + w[k, -1])
            share = 1 / (classes * size[y])
            loss += share * (max(0, 1 - m) ** 2 if m >= -1 else -4 * m)
            slope = share * sign * (-2 * max(0, 1 - m) if m >= -1 else -4)
            for i, v in x.items():
                grad[k, i] += slope * v / norm
            grad[k, -1] += slope
    assert kept["g"][0] == pytest.approx(loss) and np.allclose(kept["g"][1], grad)


def test_optimiser_finds_the_minimum():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    a, b = a @ a.T + np.eye(12), rng.normal(size=(1, 12))
    w = huber.minimised(lambda v: (float(0.5 * (v @ a @ v.T)[0, 0] - (b * v).sum()), v @ a - b), np.zeros((1, 12)), 60)
    assert np.allclose(w, np.linalg.solve(a, b.T).T, atol=1e-2)


@pytest.mark.parametrize("classes", [2, 3])
def test_held_out_precision(spark, classes):
    df = spark.createDataFrame(texts(300, 7, classes), "doc_id long, text string, label int")
    model = huber.train(df.where("doc_id % 4 <> 0"), classes=classes, bits=12, steps=15)
    got = huber.scored(model, df.where("doc_id % 4 = 0")).join(df, "doc_id").collect()
    best = [(int(np.argmax(r.p)), r.label) for r in got if max(r.p) > 0.5]
    assert len(best) > 50 and sum(a == b for a, b in best) >= 0.9 * len(best)
    assert all(sum(r.p) == pytest.approx(1) and len(r.p) == classes for r in got)


def test_labels_of_one_kind_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a word", 1)], "doc_id long, text string, label int")
    for rows in (df, df.limit(0)):
        assert [r.p for r in huber.scored(huber.train(rows, bits=8), df).select(F.col("p")).collect()] == [[0.5, 0.5]]


def test_query_is_right_on_held_out_documents(spark, sf):
    from corpusloom.plans import registry

    got = registry.queries()["m2_huber_classifier"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert got and {r.doc_id for r in got} <= {i for i in labels if i % 3 == 0}
    right = sum(labels[r.doc_id] == r.predicted for r in got)
    most = max(sum(labels[r.doc_id] == y for r in got) for y in (0, 1))
    assert right >= most and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
