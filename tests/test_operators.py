"""Operators beyond the registered queries: edge cases, readers, lineage, classifier, streaming."""

import gzip
import io
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import taxonomy, text
from corpusloom.operators import audit, classify, dedup, lineage, retrieval, sampling, spine
from corpusloom.sources import readers
from corpusloom.streaming import incremental


def test_exact_key_and_normal_form(spark):
    rows = [("A b!",), ("a  B",), ("é x",), ("é x",), ("elétron",), ("eletron",), ("a_b ²",)]
    keys = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.exact_key(F.col("t"))).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] != keys[5]


def test_keep_latest_is_deterministic_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "2020", "b"), (1, "2020", "c"), (2, None, "d")], "id int, stamp string, v string")
    assert sorted(map(tuple, spine.keep_latest(df, "id", "stamp", "v").collect())) == [(1, "2020", "c"), (2, None, "d")]


def test_splits_never_overlap_on_short_tables(spark):
    df = spark.range(15).withColumnRenamed("id", "k")
    rows = sampling.head_tail_split(df, "k", 10).collect()
    assert len({r.k for r in rows}) == len(rows) == 15
    train, held = sampling.split_by_anchor(spark.range(20).selectExpr("id % 7 AS a", "id AS b"), "a")
    assert held.select("a").distinct().count() == 1 and sampling.leaked(train, held, "a").count() == 0


def test_review_sample_counts_over_all_rows(spark, tmp_path):
    """Many rows in no order: every 97th of all, whatever sample the ranges are drawn from; null keys come last."""
    spark.range(400_000).selectExpr("CASE WHEN id % 50000 = 7 THEN NULL ELSE (id * 7919) % 400009 END AS k", "id % 3 AS lang").repartition(8).write.parquet(str(tmp_path / "in"))
    rows = sorted((r.k is None, r.k or 0, r.lang) for r in spark.read.parquet(str(tmp_path / "in")).collect())
    expected = [k for i, (_, k, lang) in enumerate(rows, 1) if i % 97 == 0 and lang == 1][:2000]
    got = sampling.review_sample(spark.read.parquet(str(tmp_path / "in")), "k", F.col("lang") == 1, most=2000)
    assert [r.k for r in got.collect()] == expected and got.columns == ["k", "lang"]


def test_recovered_subfields(spark):
    df = spark.createDataFrame([("chao-dyn", "Outro"), ("math.AP", "Outro"), ("hep-th", "kept")], "primary_category string, subfield string")
    assert [r.subfield for r in taxonomy.recover_subfield(df).collect()] == ["Dinâmica Não-Linear", "Outro", "kept"]
    assert taxonomy.recover_subfield(df.drop("subfield")).columns == ["primary_category"]


def test_spine_with_and_without_works(spark):
    rows = [("1", "2020", "2021", "cond-mat.x", ["cond-mat.x"], None, None, "1999-01-01"), ("1", "2021", "2021", "hep-th", ["hep-th"], None, "J", "1999-01-01")]
    df = spark.createDataFrame(rows, "arxiv_id string, datestamp string, updated string, primary_category string, categories array<string>, license string, journal_ref string, created string")
    works = spark.createDataFrame([("1", 3, 9), ("1", 4, 2), (None, 1, 1)], "arxiv_id string, n_references int, cited_by_count int")
    row = spine.build_spine(df, works).collect()[0]
    assert (row.archive, row.partition, row.n_references, row.cited_by_count, row.year) == ("hep-th", "train_only", 3, 9, 1999)
    assert spine.build_spine(df).collect()[0].n_references is None


@pytest.mark.parametrize("a, b, p", [(0, 0, 1.0), (30, 0, 2 * 0.5**30), (20, 20, 1.0), (8, 0, 2 * 0.5**8)])
def test_binomial(a, b, p):
    assert math.isclose(retrieval.binomial_p(a, b), p, rel_tol=1e-9)


def test_mcnemar_and_gate(spark):
    frame = lambda ranks: spark.createDataFrame(list(enumerate(ranks)), "q int, pos int")
    assert retrieval.mcnemar(frame([1] * 30), frame([2] * 30), "q")["verdict"] == "a"
    assert retrieval.mcnemar(frame([1] * 3), frame([2] * 3), "q")["verdict"] == "undecided"
    with pytest.raises(ValueError):
        retrieval.mcnemar(frame([1]), frame([1, 2]), "q")
    models = [{"path": "o", "ours": True, "ndcg_10": 0.35, "params_m": 20}, {"path": "r", "ndcg_10": 0.30, "params_m": 100}, {"path": "g", "ndcg_10": 0.34, "params_m": 335}]
    assert retrieval.gate(models, "r", {"g"}) == {"domain": "passed", "general": "passed"}
    assert retrieval.gate(models[1:], "r", {"g"}) == {"domain": "undetermined", "general": "undetermined"}


def test_near_clusters(spark):
    base = "the atlas detector at the large hadron collider observed an excess of events in the two photon channel near one hundred and twenty five"
    rows = [(1, base), (2, base + " gev"), (3, "entirely different words about the weather in spring and autumn and other seasons of a year")]
    got = dedup.near_clusters(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.7).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]


def test_crowded_buckets_are_whole(spark):
    """A group of 700 copies and one of 600 near copies: each shares its buckets with more than 500."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    same, base = " ".join(word() for _ in range(40)), [word() for _ in range(300)]
    rows = [(i, same) for i in range(700)]
    for i in range(700, 1300):
        own = list(base)
        for _ in range(i % 3 + 3 * (i % 50 == 0)):
            own[rng.randrange(300)] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(1300, 1310)]
    df = spark.createDataFrame(rows, "id long, t string")
    sigs = dedup.cut(dedup.signatures(df, "id", "t"))
    held = {r.id: np.array(r.signature) for r in sigs.collect()}
    ids = sorted(held)
    sig, expected, root = np.stack([held[i] for i in ids]), {}, list(ids)
    for a in ids:
        equal = sig[a + 1 :] == sig[a]
        meet = equal.reshape(len(equal), dedup.BANDS, dedup.ROWS).all(axis=2).any(axis=1)
        for b in (np.flatnonzero(meet) + a + 1).tolist():
            expected[a, b] = equal[b - a - 1].sum() / 128.0
    for _ in ids:
        before = list(root)
        for (a, b), e in expected.items():
            if e >= 0.85:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    linked = {x for p, e in expected.items() if e >= 0.85 for x in p}
    assert {r.id: r.root for r in dedup.near_clusters(df, "id", "t").collect()} == {i: root[i] for i in linked}
    assert len(linked) > 1200
    got = dedup.scored_pairs(sigs, "id").collect()
    assert len(got) == len(expected) and {(r.a, r.b): r.estimate for r in got} == expected
    assert dedup.pair_count(*dedup.class_pairs(sigs, "id")).first().pairs_scored == len(expected)


def test_audit_of_sources(spark):
    src = spark.createDataFrame([(1, r"\newcommand{\E}{\mathcal{E}} $\E = 1$ $a=b+c$")], "k int, tex string")
    out = spark.createDataFrame([(1, r"$\mathcal{E}=1$")], "k int, tex string")
    row = audit.compare(audit.canonical_sets(src, "k", "tex"), audit.canonical_sets(out, "k", "tex"), "k").collect()[0]
    assert (row.n_source, row.n_copy, row.preserved, row.absent, row.discordant) == (2, 1, 1, 1, 0)
    few = spark.createDataFrame([(1, 1, 2)], "k int, p int, w int")
    assert audit.bootstrap_ratio(few, "k", "p", "w", 10).collect()[0].lo is None


def test_compared_sets_may_repeat_forms_and_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "ROWS", 10)
    source = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "k int, form string")
    copy = spark.createDataFrame([(1, "a"), (1, "x"), (1, "x"), (2, "c"), (2, "c"), (None, "d"), (4, "e")], "k int, form string")
    rows = {r.k: tuple(r)[1:] for r in audit.compare(source, copy, "k").collect()}
    assert rows == {1: (2, 2, 1, 0, 1), 2: (1, 1, 1, 0, 0), None: (1, 1, 0, 0, 1)}
    many = spark.range(200).selectExpr("id DIV 2 AS k", "id AS form")
    assert audit.compare(many, many, "k").rdd.getNumPartitions() == 40


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "url": "u"}\nnot json\n{"text": "y"}\n')
    rows = readers.slice_columns(readers.json_lines(spark, str(tmp_path / "a.jsonl"), "text string, url string")).collect()
    assert sorted((r.texto, r.url) for r in rows) == [("x", "u"), ("y", None)]
    page = """<r><record><header><identifier>oai:1</identifier><datestamp>2020-01-01</datestamp></header><metadata><arXiv><id>1</id><title>T</title><authors><author><keyname>K</keyname><forenames>F</forenames></author></authors><categories>hep-th math.AP</categories></arXiv></metadata></record>
    <record><header status="deleted"><identifier>oai:2</identifier><datestamp>2020-01-01</datestamp></header></record></r>"""
    (tmp_path / "p.xml").write_text(page)
    row = readers.oai_records(spark, str(tmp_path / "p.xml")).collect()
    assert len(row) == 1 and (row[0].arxiv_id, row[0].authors, row[0].primary_category, row[0].license) == ("1", ["F K"], "hep-th", readers.DEFAULT_LICENSE)
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        info = tarfile.TarInfo("m.tex")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"$a$"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.gz").write_bytes(data.getvalue())
    (tmp_path / "src/b.gz").write_bytes(gzip.compress(b"plain"))
    assert sorted(str(r.files) for r in readers.source_bundles(spark, str(tmp_path / "src")).collect()) == ["{'m.tex': '$a$'}", "{'main.tex': 'plain'}"]


def test_resume_and_retries():
    assert readers.done_units('{"unidades": [1, 2]}') == {1, 2} and readers.done_units('{"shards": [3]}') == {3} and readers.done_units("broken") == set()
    assert readers.may_retry(None) and readers.may_retry(503) and readers.may_retry(429) and not readers.may_retry(404)
    assert readers.retry_delay(3) >= 8 and readers.retry_delay(20) <= 750 and readers.retry_delay(1, retry_after=5) == 5
    assert readers.acquisition_problems({"failures": [{"unit": 1, "retryable": True}, {"unit": 2}]}) == {"start": ["license"], "complete": [1]}
    assert incremental.same_snapshot(None, {"snapshot": 1}) and not incremental.same_snapshot({"snapshot": 1, "cursor": 3}, {"snapshot": 2})


def test_lineage(spark, tmp_path):
    folder = tmp_path / "stage"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"1")
    (folder / "b.bin").write_bytes(b"2")
    before = lineage.file_index(spark, str(folder))
    manifest = lineage.stage_manifest(spark, "s", str(folder), {"p": 1}, {})
    kept = spark.createDataFrame(before.collect(), before.schema)
    shallow = spark.createDataFrame(lineage.file_index(spark, str(folder), deep=False).collect(), before.schema)
    root = lineage.root_manifest({"s": manifest}, ["s"])
    assert lineage.broken_seals({"s": manifest}, root) == []
    (folder / "a.bin").write_bytes(b"9")
    (folder / "c.bin").write_bytes(b"3")
    (folder / "b.bin").unlink()
    spark.catalog.refreshByPath(str(folder))
    assert sorted(map(tuple, lineage.divergences(kept, lineage.file_index(spark, str(folder))).collect())) == [("a.bin", "altered"), ("b.bin", "absent"), ("c.bin", "extra")]
    assert ("a.bin", "altered") not in map(tuple, lineage.divergences(shallow, lineage.file_index(spark, str(folder), deep=False)).collect())
    assert lineage.broken_seals({"s": manifest | {"root": "x"}}, root) == [("s", "manifest"), ("s", "stage")]
    assert lineage.broken_seals({"s": manifest}, root | {"stages": {"s": "x"}})[-1] == ("", "root")
    with pytest.raises(ValueError):
        lineage.root_manifest({}, ["s"])
    assert lineage.preserved({"captured": "execution", "root": 1}, {"root": 1}) == {"captured": "execution", "root": 1}


def test_classifier_decides_and_abstains(spark, tmp_path):
    rows = [(i, ("quark gluon field " if i % 2 else "market price trade ") * 5 + f"w{i % 9}", i % 2, "positive" if i % 2 else f"d{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string, label int, domain string")
    model = classify.train(df, iterations=10)
    classify.save(model, str(tmp_path / "model"))
    scored = classify.probabilities(classify.load(str(tmp_path / "model")), df)
    assert scored.where((F.col("p")[1] >= 0.5) != (F.col("label") == 1)).count() == 0
    assert scored.select(classify.decided(F.col("p"), [0, 1], {0: 1.01, 1: 0.5}).alias("d")).groupBy("d").count().count() == 2
    assert classify.accepted(model, df, 0.5).count() == 60
    assert {r.omitted for r in classify.leave_one_out(df, "domain", hashed=True, iterations=5).collect()} == {"d0", "d1", "d2"}


def test_counts_are_stored_once_and_give_the_same_model(spark, monkeypatch):
    """Counts without Python functions, equal to those of the stages; texts are taken apart once for all domains."""
    rows = [(i, " ".join(f"w{(i * j) % 13} w{j % 5}" for j in range(1, 9)), i % 2, f"d{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label int, domain string")
    assert "Python" not in classify.damped_counts(df, "text", "id")._jdf.queryExecution().toString()
    with classify.Tables(spark) as tables:
        counted = classify.counted_once(tables, df, "text", "id", "label")
        old, new = classify.train(df, hashed=True, iterations=5), classify.train_counted(counted, iterations=5)
        a, b = ({r.id: r.p[1] for r in classify.probabilities(m, x).select("id", "p").collect()} for m, x in ((old, df), (new, counted)))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)
    made, plain = [], classify.damped_counts
    monkeypatch.setattr(classify, "damped_counts", lambda *x: made.append(x) or plain(*x))
    assert classify.leave_one_out(df, "domain", hashed=True, iterations=2).count() == 3 and len(made) == 1


def test_stream_resumes_without_repeats(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    spark.range(10).write.parquet(at["in"])
    for extra in (None, 20):
        if extra:
            spark.range(10, extra).write.mode("append").parquet(at["in"])
        incremental.process_new_files(spark, at["in"], "id long", at["out"], at["ck"], lambda s: s.where("id % 2 = 0"), 2)
    assert sorted(r.id for r in spark.read.parquet(at["out"]).collect()) == list(range(0, 20, 2))


def test_cached_vectors_go_by_id(spark):
    cache = spark.createDataFrame([(3, [0.3]), (1, [0.1]), (9, [0.9])], "id long, v array<double>")
    found, missing = retrieval.cached_vectors(cache, spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id")
    assert sorted((r.id, r.v) for r in found.collect()) == [(1, [0.1]), (3, [0.3])] and [r.id for r in missing.collect()] == [2]


def test_package_and_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 3 AS part")
    manifest = readers.training_package(df, str(tmp_path / "p"), 5, "id")
    assert sorted(r.id for r in readers.table(spark, str(tmp_path / "p"), "id").collect()) == [0, 1, 2, 3, 4]
    assert manifest["rows"] == 5 and all(len(h) == 64 for h in manifest["files"].values())
    readers.write_table(df, str(tmp_path / "q"), "part")
    assert readers.recursive_table(spark, str(tmp_path / "q"), "id long").count() == 20
    readers.write_json(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "id long, part long").count() == 20
    with pytest.raises(Exception, match="(?i)raise_error|no such luck"):
        readers.write_table(df.selectExpr("raise_error('no such luck') AS id"), str(tmp_path / "q"))
    assert readers.recursive_table(spark, str(tmp_path / "q"), "id long").count() == 20  # a failed write leaves the old table
    readers.write_table(df.limit(3), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3 and not list(tmp_path.glob("q.old*"))
    done = spark.createDataFrame([(1,)], "id long")
    assert readers.pending_units(df, done, "id").count() == 19


def test_acquisition_manifest(tmp_path):
    path = str(tmp_path / "m/manifest.json")
    manifest = readers.AcquisitionManifest(path, "resolved", "abc")
    manifest.data["failures"] = [{"unit": 1, "retryable": True}]
    manifest.save()
    again = readers.AcquisitionManifest.load(path)
    assert again.data == manifest.data and again.can_start() and not again.can_complete()
    assert again.can_resume("abc") and not again.can_resume("def")
    with pytest.raises(ValueError):
        again.mark_complete()
    again.mark_complete(force=True)
    assert readers.AcquisitionManifest.load(path).data["forced"] is True
    assert not readers.AcquisitionManifest.load(str(tmp_path / "none")).can_start()


def test_protocol_cache(spark):
    rows = [("q1", 1.0, "a", 2, 512), ("q2", 2.0, "a", 2, 512)]
    cache = spark.createDataFrame(rows, "query string, pos double, digest string, n int, max_tokens int")
    same = {"digest": "a", "n": 2, "max_tokens": 512}
    assert retrieval.usable_cache(cache, same).count() == 2
    for other in ({"digest": "b"}, {"n": 3}, {"max_tokens": 256}):
        assert retrieval.usable_cache(cache, same | other).count() == 0


def test_a_bucket_above_the_limit_is_reported(spark):
    """One bucket of 501 members, one of 500 and single ones: only the first is in the report, and no pair of it is given."""
    from corpusloom.operators import dedup

    rows = [(i, 0, "hot") for i in range(501)] + [(i, 1, "full") for i in range(500)] + [(i, 2, f"b{i}") for i in range(50)]
    pairs, skipped = dedup.candidate_pairs(spark.createDataFrame(rows, "k long, band int, bucket string"), "k")
    assert [tuple(r) for r in skipped.collect()] == [(0, "hot", 501)]
    assert pairs.count() == 500 * 499 // 2 and pairs.where("b >= 500").count() == 0


def test_the_guard_finds_a_planted_leak(spark):
    from corpusloom.operators import sampling

    train = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, v string")
    held = spark.createDataFrame([(3, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert sorted(r.v for r in sampling.leaked(train, held, "k").collect()) == ["b", "c"]


def test_only_texts_that_nfc_may_change_go_to_python(spark, monkeypatch):
    import re
    import unicodedata

    open_to = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", text.MAYBE_OPEN))
    kept = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not open_to.search(c)]
    parts = [unicodedata.decomposition(c).split() for c in map(chr, range(0x110000))]
    joined = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"} | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    assert len(kept) > 30_000 and not joined & set(kept)
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) for c in kept)
    stay, go = ["Été — “größer” жй 漢字 かな 한글 10 €", "plain", ""], ["e\u0301te\u0301", "\u212b", "\u1112\u1161\u11ab", "가\u11a8", "か\u3099", "\uf900"]
    rows = spark.createDataFrame([(x,) for x in stay + go], "t string")
    assert [r.n for r in rows.select(text.composed(F.col("t")).alias("n")).collect()] == [unicodedata.normalize("NFC", x) for x in stay + go]
    monkeypatch.setattr(text, "nfc", lambda c: F.when(c.isNotNull(), F.lit("python")))
    assert [r.n for r in rows.select(text.composed(F.col("t")).alias("n")).collect()] == stay + ["python"] * len(go)


def test_signatures_and_pairs_leave_a_task_in_small_batches(spark, monkeypatch):
    """One bucket of 400 signatures, the last of its task, has 79,800 pairs; no batch may hold them all."""
    caught = []
    frame = type(spark.range(1))
    with monkeypatch.context() as m:
        m.setattr(frame, "mapInArrow", lambda self, f, schema: caught.append((self, f)) or self)
        dedup.signatures(spark.createDataFrame([(i, f"w{i} is a text of its own") for i in range(2500)], "id long, t string").coalesce(1), "id", "t")
        same = [7] * (dedup.N_PERM - 1)
        dedup.bucket_pairs(spark.createDataFrame([(i, [*same, i]) for i in range(400)], "id long, signature array<long>"), "id")
    for rows, run in caught:
        batches = list(run(iter(rows.toArrow().combine_chunks().to_batches())))
        if "signature" in batches[0].schema.names:
            assert sum(b.num_rows for b in batches) == 2500 and max(b.num_rows for b in batches) <= dedup.OUT_ROWS
        else:
            assert max(b.num_rows for b in batches) <= dedup.OUT_PAIRS
            pairs = [(r["a"], r["b"]) for b in batches for r in b.to_pylist()]
            assert len(pairs) == len(set(pairs)) == 400 * 399 // 2
