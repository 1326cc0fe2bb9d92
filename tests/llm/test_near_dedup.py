import random

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import near_dedup as m
from corpusloom.llm._store import Scratch
from corpusloom.llm.components import connected_components

WORDS = [f"w{i}" for i in range(4000)]


def brute(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in con.execute(m.BRUTE_SQL).fetchall():
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def varied(seed):
    """Groups of copies with more and fewer edits, a chain, and unrelated texts."""
    rng, rows = random.Random(seed), []
    for group in range(6):
        base = [rng.choice(WORDS) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.choice([2, 5, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append(" ".join(own))
    chain = [rng.choice(WORDS) for _ in range(150)]
    for _ in range(30):
        chain = list(chain)
        chain[rng.randrange(150)] = rng.choice(WORDS)
        rows.append(" ".join(chain))
    rows += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows += ["Same Words", "same  words ", "", "  \n", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = varied(seed)
        got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_other_columns(spark):
    text = " ".join(WORDS[:50])
    rows = [(3, text, 1), (1, text, 2), (1, text, 3), (None, text, 4), (7, None, 5), (8, None, 6), (9, "", 7)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in got) == [(-1, 46, None, True), (1, 46, 1, True), (1, 46, 1, True), (3, 46, 1, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    kept = m.keep_one(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()
    assert sorted(r.label for r in kept) == [2, 3, 4, 5, 6, 7]
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_of_components(spark):
    n = 300
    nodes = spark.range(n).selectExpr("id AS v", "id AS label")
    edges = spark.range(n - 1).selectExpr("(id * 7) % 300 AS a", "((id + 1) * 7) % 300 AS b")
    with Scratch(spark) as scratch:
        assert {r.label for r in connected_components(nodes, edges, scratch).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB \t\né1. "), max_size=40), max_size=6))
def test_shingles_equal_plain_python(texts):
    def plain(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [plain(t) for t in texts]
    got = m.unique_sets(pa.array(texts, pa.string()))
    assert [len(g) for g in got] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(sets[i] & sets[j])


def test_fingerprints_tell_structured_words_apart():
    """Thue-Morse words and their complements, which polynomials modulo 2**64 confuse, blocks in another order, and all short words."""
    import numpy as np

    from corpusloom.llm import _text

    bits = [0]
    words = []
    for _ in range(12):
        bits += [1 - x for x in bits]
        words += ["".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)]
    words += ["12345678abcdefgh", "abcdefgh12345678", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 100_000, "a" * 100_001, "", "\0", "\0\0"]
    words += [a + b for a in "abcdefgh" for b in "abcdefgh"]
    words = list(dict.fromkeys(words))
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = _text.fingerprints(data, ends - [len(w) for w in words], ends)
    assert len(set(got.tolist())) == len(words)
    assert [_text.fingerprint(w) for w in words] == got.tolist()


def test_very_long_texts_and_only_the_result_stays(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    rng = random.Random(9)
    long = [rng.choice(WORDS) for _ in range(300_000)]
    other = list(long)
    for k in range(0, 300_000, 100):  # 1 % of the words: about 5 % of the shingles
        other[k] = "changed"
    rows = [(5, " ".join(long)), (2, " ".join(other)), (9, " ".join(long[:200_000])), (7, "short text of six words only")]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 2, 2: 2, 9: 9, 7: 7}
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before} == {"near-duplicates"}


def test_pairs_of_a_hot_pivot_are_dealt_out(spark):
    """One group of 400 near copies: no task of the comparison gets more than a few times the mean."""
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(own)))
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 400)], "oid long, pivot long")
    texts = spark.createDataFrame(rows, "oid long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        with Scratch(spark) as scratch:
            m.verified(pairs, texts, 85, scratch).count()
            wanted = spark.read.parquet(next(x for x in scratch.paths if "wanted" in x))
            assert wanted.where("kind = 1").groupBy("salt").count().agg({"count": "max"}).first()[0] <= 3 * m.SALT_ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = m.near_duplicates(texts, id_col="oid").collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
