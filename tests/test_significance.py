"""Ranks, Wilcoxon's test and false discovery rates against their definitions."""

import math
import random

import pytest

from corpusloom.operators import significance as sg


def test_average_ranks(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(30)]) for _ in range(400)]
    got = sg.average_ranks(spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "i int, v int, rank_of int").repartition(6), "v").collect()
    known = [v for v in values if v is not None]
    for r in got:
        assert r.rank == (None if r.v is None else sum(x < r.v for x in known) + (known.count(r.v) + 1) / 2)
    assert len(got) == len(values)


def signed(pairs):
    d = [a - b for a, b in pairs if a is not None and b is not None]
    own = [x for x in d if x]
    rank = lambda x: sum(abs(y) < abs(x) for y in own) + (sum(abs(y) == abs(x) for y in own) + 1) / 2
    plus, minus = sum(rank(x) for x in own if x > 0), sum(rank(x) for x in own if x < 0)
    n = len(own)
    ties = sum(k**3 - k for k in (sum(abs(y) == s for y in own) for s in {abs(x) for x in own}))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (plus - n * (n + 1) / 4) / math.sqrt(variance) if variance else None
    return n, len(d) - n, plus, minus, z, None if z is None else math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("seed", [2, 3])
def test_wilcoxon(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([None, *range(12)]), rng.randrange(10)) for _ in range(300)]
    r = sg.wilcoxon(spark.createDataFrame(pairs, "a int, b int").repartition(5), "a", "b").first()
    n, zero, plus, minus, z, p = signed(pairs)
    assert (r.n, r.zero, r.w_plus, r.w_minus) == (n, zero, plus, minus) and r.z == pytest.approx(z) and r.p == pytest.approx(p, abs=2e-7)


def test_wilcoxon_without_differences(spark):
    r = sg.wilcoxon(spark.createDataFrame([(1, 1), (2, 2)], "a int, b int"), "a", "b").first()
    assert (r.n, r.zero, r.z, r.p) == (0, 2, None, None)


def corrected(ps):
    known = sorted(p for p in ps if p is not None and not math.isnan(p))
    raw = {p: p * len(known) / sum(x <= p for x in known) for p in known}
    return {p: min(1.0, *(v for x, v in raw.items() if x >= p), 1.0) for p in known}


def test_false_discovery(spark):
    rng = random.Random(4)
    tests = [(i, rng.choice(["a", "b", None]), rng.choice([None, math.nan, 0.0, 0.01, 0.5, 1.0, round(rng.random() ** 3, 3)])) for i in range(500)]
    df = spark.createDataFrame(tests, "i int, f string, pv double").repartition(7)
    for family in (None, ["f"]):
        got = sg.false_discovery(df, "pv", 0.1, family).collect()
        assert len(got) == len(tests)
        for r in got:
            own = corrected([p for _, f, p in tests if family is None or f == r.f])
            if r.pv is None or math.isnan(r.pv):
                assert r.q is None and not r.rejected
            else:
                assert r.q == pytest.approx(own[r.pv], abs=1e-12) and r.rejected == (r.q <= 0.1)


def test_probabilities(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-60, 61)], "z double")
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=2e-7) for r in rows.select("z", sg.two_sided_p(rows.z).alias("p")).collect())
