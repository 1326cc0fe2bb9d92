"""The inverted index, its exact search with skipping, and the fusion of ranks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    """Every document against every query, by the formula."""
    bags = {}
    for i, text in docs:
        if i is not None:
            bags.setdefault(i, Counter()).update(words(text))
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(w for b in bags.values() for w in b)
    out = set()
    asked = {}
    for q, text in queries:
        if q is not None:
            asked.setdefault(q, set()).update(words(text))
    for q, terms in asked.items():
        scored = []
        for i, bag in bags.items():
            length = sum(bag.values())
            parts = [math.floor(1e6 * (round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)), 9) * (bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * length / (total / n)))))) for w in terms if w in bag]
            if parts:
                scored.append((-sum(parts), i))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def case(seed, n):
    rng = random.Random(seed)
    names = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)] + ["The", "the", "Été", "漢字"]
    docs = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(40)))) for i in range(n)]
    docs += [(i + n, docs[i][1]) for i in range(0, n, 5)] + [(0, "more the words"), (None, "the w1"), (9_000, None), (9_001, ""), (9_002, "..."), (9_003, "the " * 3000)]
    queries = [(q, " ".join(rng.choice(names) for _ in range(rng.randrange(1, 15)))) for q in range(12)] + [(50, "the"), (51, "nowhere"), (52, None), (53, ""), (None, "the"), (54, "The, the! w1 w1"), (1, "w2")]
    return docs, queries


@pytest.mark.parametrize(("block", "first", "k"), [(256, 4096, 10), (4, 3, 3), (1, 1, 1), (7, 10, 500)])
def test_search_equals_brute_force(spark, tmp_path, block, first, k):
    docs, queries = case(block, 150)
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, block int")
    asked = spark.createDataFrame([(*r, "x") for r in queries], "item_id long, text string, term string")
    index = lexical.inverted_index(frame, str(tmp_path / "index"), block=block)
    assert index.documents == len({i for i, _ in docs if i is not None}) and index.n_blocks == -(-index.documents // block)
    found = lexical.search(index, asked, k, first=first).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(docs, queries, k)
    again = lexical.search(lexical.open_index(spark, str(tmp_path / "index")), asked, k)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found}


def test_blocks_hold_every_posting_once_and_their_largest_weight(spark, tmp_path):
    docs, _ = case(3, 120)
    index = lexical.inverted_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"), block=8)
    every = index.blocks.select("block", "term", "n", "most", "least", F.explode(F.arrays_zip(F.col("docs").alias("doc"), F.col("counts").alias("tf"))).alias("p")).select("block", "term", "n", "most", "least", "p.*").collect()
    bags = {}
    for i, t in docs:
        if i is not None:
            bags.setdefault(i, Counter()).update(words(t))
    rows = [r for r in every if r.term is not None]
    assert {(r.doc, r.tf) for r in every if r.term is None} == {(i, sum(b.values())) for i, b in bags.items()} and len(every) - len(rows) == len(bags)
    assert {(r.doc, r.term, r.tf) for r in rows} == {(i, w, n) for i, b in bags.items() for w, n in b.items()} and len(rows) == sum(map(len, bags.values()))
    by = {}
    for r in rows:
        by.setdefault((r.block, r.term), []).append(r)
    assert all(x[0].n == len(x) and x[0].most == max(r.tf for r in x) and x[0].least == min(sum(bags[r.doc].values()) for r in x) for x in by.values())
    assert len({r.block for r in rows if r.term == "the"}) > 5  # a frequent term lies in many blocks


def test_most_blocks_of_frequent_terms_are_skipped(spark, tmp_path):
    """A rare word decides: its documents score above what all the frequent words of the query can give."""
    docs = [(i, "common words everywhere " + ("needle needle needle" if i % 100 == 0 else f"other{i}")) for i in range(2000)]
    index = lexical.inverted_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"), block=10)
    asked = spark.createDataFrame([(1, "common words everywhere needle")], "item_id long, text string")
    seen = []
    kept, lexical.sums = lexical.sums, lambda *a: seen.append(a[0].count()) or kept(*a)
    try:
        found = lexical.search(index, asked, 10).collect()
    finally:
        lexical.sums = kept
    assert {tuple(r) for r in found} == brute(docs, [(1, "common words everywhere needle")], 10)
    assert seen[-1] <= 4 * 20 < index.n_blocks * 4  # terms times blocks: those of the needle's documents only


def test_no_documents_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = lexical.inverted_index(none, str(tmp_path / "empty"))
    assert lexical.search(index, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    index = lexical.inverted_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "one"))
    assert lexical.search(index, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_fusion_equals_its_definition(spark):
    rng = random.Random(8)
    lists = [{(q, c): rng.choice([0.1, 0.5, 0.5, 0.9]) for q in range(6) for c in rng.sample(range(30), rng.randrange(12))} for _ in range(3)]
    depths, weights = (3, 5, 100), (1.0, 0.5, 2.0)
    ranks = []
    for scores, depth in zip(lists, depths):
        found = {(q, c): 1 + sum(s2 > s for (q2, _), s2 in scores.items() if q2 == q) for (q, c), s in scores.items()}
        ranks.append({p: r for p, r in found.items() if r <= depth})
    frames = [lexical.ranked(spark.createDataFrame([(q, c, s) for (q, c), s in x.items()] + [(None, 1, 1.0), (1, None, 9.0), (2, 7, None)], "a long, b long, s double"), "a", "b", "s", n) for x, n in zip(lists, depths)]
    assert [{(r.query, r.candidate): r.rank for r in f.collect()} for f in frames] == ranks
    got = {(r.query, r.candidate): (r.score, r.rank_0, r.rank_1, r.rank_2) for r in lexical.fused(frames, weights=list(weights)).collect()}
    assert set(got) == {p for x in ranks for p in x}
    for p, (score, *own) in got.items():
        assert own == [x.get(p) for x in ranks] and score == pytest.approx(sum(w / (60 + r) for w, r in zip(weights, own) if r), abs=1e-15)
    best = lexical.fused_top(frames, 4, weights=list(weights)).collect()
    for q in range(6):
        order = sorted((-s, *[math.inf if r is None else r for r in own], c) for (qq, c), (s, *own) in got.items() if qq == q)
        assert [(r.candidate) for r in sorted((x for x in best if x.query == q), key=lambda x: x.rank)] == [x[-1] for x in order[:4]]


def test_a_pair_that_a_list_repeats_counts_once(spark):
    part = spark.createDataFrame([(1, 2, 5), (1, 2, 3)], "query long, candidate long, rank long")
    assert [tuple(r) for r in lexical.fused([part, part.limit(0)]).collect()] == [(1, 2, 1 / 63, 3, None)]


def test_what_queries_send_grows_with_few_blocks(spark, tmp_path, monkeypatch):
    """2,000 documents with the same words: every query goes to every block, so blocks must not be small."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.col("id") % 7).alias("text"))
    asked = spark.createDataFrame([(q, "the word") for q in range(5)], "item_id long, text string")
    sent, real = [], lexical.sums
    monkeypatch.setattr(lexical, "sums", lambda terms, *rest: sent.append(terms.count()) or real(terms, *rest))
    found = lexical.search(lexical.inverted_index(docs, str(tmp_path / "index")), asked, 10).collect()
    assert {(r.query, r.doc, r["rank"]) for r in found} == {(q, i, i + 1) for q in range(5) for i in range(10)}
    assert max(sent) <= 5 * 2 * 2  # queries, terms, blocks
