import duckdb
import pyarrow as pa
import pytest

from corpusloom.llm.decontaminate import OP7_SQL, decontaminate, op7_decontaminate

ITEM = "One two three, four five six seven eight nine ten eleven twelve."
BENCH = [(10, ITEM), (2, "Tiny item!"), (3, None), (4, "..."), (5, "one TWO three four five six seven eight nine ten")]
DOCS = [
    (1, "x y one two three four five six seven eight nine ten z one two"),
    (2, "a tiny ITEM; and tiny items"), (3, None), (4, ""), (5, "two three four five six seven eight nine ten"),
    (6, "zwölf " * 30 + ITEM + " " + ITEM), (6, "other text"), (None, "tiny item"), (7, "one two three four five six seven eight nine ten eleven twelve"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_marks_equal_the_sql(spark, limit):
    docs = [(i, t) for i, t in DOCS if i is not None and t != "other text"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": pa.array([r[1] for r in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": [r[0] for r in BENCH], "text": pa.array([r[1] for r in BENCH], pa.string())}))
    expected = {r[0]: (r[1], r[2], r[3], r[5]) for r in con.execute(OP7_SQL).fetchall()}
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string"), max_broadcast_bytes=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out.collect()} == expected


def test_modes_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in DOCS], "doc_id long, text string, items string, item_id int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    marked = decontaminate(docs, bench).collect()
    assert len(marked) == len(DOCS) and {r.text for r in marked if r.contaminated and r.doc_id is None} == {"tiny item"}
    assert [r["items"] for r in marked if r.text and r.text.startswith("zw")] == [["10", "5"]]
    kept = decontaminate(docs, bench, "documents").collect()
    assert sorted((r.doc_id, r.text or "", r["items"]) for r in kept) == [(3, "", "k"), (4, "", "k"), (5, DOCS[4][1], "k"), (6, "other text", "k")]
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, "spans").collect() if r.doc_id in (1, 2, 5, 7)}
    assert spans == {1: "x y z one two", 2: "a and tiny items", 5: DOCS[4][1], 7: ""}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted(map(tuple, op7_decontaminate(spark, sf).collect())) == sorted(con.execute(OP7_SQL).fetchall())


def test_very_long_texts_take_linear_time(spark):
    import time

    filler = "some other words that stand in no test item at all "
    body = filler * 60_000  # 660,000 words
    rows = [(1, body + ITEM + " " + filler + "tiny item", "x"), (2, (ITEM + " ") * 20_000, "x"), (3, body, "x")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, w string"), spark.createDataFrame(BENCH, "item_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (660_025, 14, ["10", "2", "5"]), 2: (240_000, 240_000, ["10", "5"]), 3: (660_000, 0, [])}
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, "spans").collect()}
    assert spans == {1: (body + filler).strip(), 2: "", 3: body}
    assert time.perf_counter() - began < 60


def test_windows_of_many_lengths(spark):
    """Items of 1 to 12 words, each at both ends and in the middle of a text."""
    words = [f"k{i}x" for i in range(200)]
    items = [(m, " ".join(words[10 * m : 10 * m + m])) for m in range(1, 13)]
    docs = [(m, f"{t} b c d {t} e f {t}") for m, t in items] + [(100, "b c d e f")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == {m: (3 * m, [str(m)]) for m, _ in items} | {100: (0, [])}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_items_without_an_id_hit_words_and_are_in_no_list(spark, limit):
    bench = [(None, ITEM), (2, "Tiny item!"), (None, "other text")]
    docs = [(i, t) for i, t in enumerate(t for _, t in DOCS)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": pa.array([r[1] for r in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([r[0] for r in bench], pa.int64()), "text": [r[1] for r in bench]}))
    expected = {r[0]: (r[1], r[2], r[3], r[5]) for r in con.execute(OP7_SQL).fetchall()}
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), max_broadcast_bytes=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out.collect()} == expected
    assert any(n_hit and not n_items for _, n_hit, n_items, _ in expected.values())
