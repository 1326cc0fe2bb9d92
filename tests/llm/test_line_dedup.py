import hashlib

import duckdb

from corpusloom.llm.line_dedup import OP3_SQL, line_dedup, op3_line_dedup

SCHEMA = "doc_id long, text string, n_lines string, oid int"


def run(spark, rows, **options):
    return {(r.doc_id, r.oid): r for r in line_dedup(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_lines_stay_in_the_smallest_document_only(spark):
    rows = [
        (5, "A shared line here\nown five line\nshort", "x", 1),
        (2, "  a SHARED line here \nshort\n a shared line here", "x", 2),
        (9, "ÀBC common accented\na shared line here\n", "x", 3),
        (7, "Àbc COMMON accented", "x", 4),
        (None, "a shared line here\nown null line", "x", 5),
        (4, None, "x", 6),
        (3, "", "x", 7),
    ]
    got = run(spark, rows, min_chars=6, n_batches=3)
    assert got[2, 2].text == "  a SHARED line here \nshort\n a shared line here" and got[2, 2].n_dropped == 0
    assert got[5, 1].text == "own five line\nshort" and (got[5, 1].n_lines, got[5, 1].n_dropped) == (3, 1)
    assert got[7, 4].text == "Àbc COMMON accented"
    assert got[9, 3].text == "" and (got[9, 3].n_lines, got[9, 3].n_dropped) == (3, 2)
    assert got[None, 5].text == "own null line"
    assert got[4, 6].text == "" and got[4, 6].n_lines == 1 and got[3, 7].n_lines == 1


def test_batches_do_not_matter_and_rows_repeat(spark):
    rows = [(i % 40, "\n".join(f"line number {k % 7} of all" for k in range(i % 40 % 9)), "x", i) for i in range(80)]
    one, four = run(spark, rows, n_batches=1), run(spark, rows, n_batches=4)
    assert one == four and len(one) == 80


def test_empty_table_and_very_long_text(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join(f"a rather long line {i % 5000}" for i in range(60_000))
    got = run(spark, [(1, long, "x", 1), (2, long, "x", 2)])
    assert got[1, 1].text == long and got[2, 2].n_dropped == 60_000 and got[2, 2].text == ""


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op3_line_dedup(spark, sf).collect())) == sorted(con.execute(OP3_SQL).fetchall())
    assert hashlib.sha256(b"").hexdigest() == con.execute("SELECT sha256('')").fetchone()[0]


def test_runs_are_merged_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm._store import Scratch, set_for
    from corpusloom.llm.line_dedup import LineRuns

    def batch(lo, hi):
        return spark.range(lo, hi).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("first_id")).repartition(4, "h1", "h2")

    with Scratch(spark) as scratch, set_for(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
        runs = LineRuns(scratch, 4)
        for k in range(7):
            runs.add(runs.sorted(batch(100 * k, 100 * k + 100), "line-run"))
        assert [run.count() for run in runs.runs()] == [100, 200, 400]
        keys = runs.sorted(batch(650, 750), "line-batch")
        plan = runs.seen(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "- Sort [" not in plan
        assert runs.seen(keys).where("seen = h2").count() == 50 and runs.seen(keys).where("seen is null").count() == 50


def test_very_long_text_that_keeps_its_lines(spark):
    """200,000 kept lines and some that go: the time is in proportion to the text."""
    import time

    common = [f"a common line {i}" for i in range(1000)]
    long = "\n".join(x for i in range(200_000) for x in ([f"an own line {i}"] + ([common[i // 200]] if i % 200 == 0 else [])))
    began = time.perf_counter()
    got = run(spark, [(1, "\n".join(common), "x", 1), (2, long, "x", 2)], n_batches=2)
    assert time.perf_counter() - began < 40
    assert (got[2, 2].n_lines, got[2, 2].n_dropped) == (201_000, 1000) and got[2, 2].text == "\n".join(f"an own line {i}" for i in range(200_000))


def test_hot_lines(spark):
    rows = [(i, "the one line that all hold\n" + f"own line of {i}" + "\nthe one line that all hold" * (i % 3), "x", i) for i in range(3000)]
    got = run(spark, rows, n_batches=3)
    assert got[0, 0].n_dropped == 0 and all(got[i, i].text == f"own line of {i}" and got[i, i].n_dropped == 1 + i % 3 for i in range(1, 3000))


def test_nothing_but_the_result_stays(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    run(spark, [(i, f"the same line\nline {i}", "x", i) for i in range(9)])
    assert {x.split("-")[0] + "-" + x.split("-")[1] for x in set(os.listdir(shared)) - before} == {"lines-gone"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]
