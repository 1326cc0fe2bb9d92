import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle as fm
from corpusloom.llm.fill_in_middle import Runs, fill_in_middle, restored

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = ["a", "é", "漢", "😀", " ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "<P>", "<S", "ab"]
TEXTS = ["", " ", "a", " a", "a ", " \n ", "a<P>b c", "x" * 100_000, "w " * 50_000 + "\n", "<S" + " <M b", "naïve\ttext  with\r\n breaks "]


def units_of(text, unit):
    """Where a text may be cut, written out: the characters before each number of units."""
    if unit == "word":
        return [0] + [m.end() for m in TOKENS.finditer(text)]
    if unit == "char":
        return list(range(len(text) + 1))
    return [0] + [k + (j == len(c.encode())) for k, c in enumerate(text) for j in range(1, len(c.encode()) + 1)]


@pytest.mark.parametrize("unit", fm.UNITS)
def test_offsets_equal_their_definition(unit):
    rng = random.Random(11)
    for text in [t for t in TEXTS if len(t) < 1000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(300)]:
        runs, ends = Runs(text, unit), units_of(text, unit)
        assert runs.total == len(ends) - 1
        assert [runs.offset(k) for k in range(len(ends))] == ends


def transformed(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKENS.findall(text)
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    parts = ["".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:])]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if form == "spm" else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
    return len(tokens), form, len(parts[0]), len(parts[1]), out


def test_rows_equal_brute_force(spark):
    rng = random.Random(12)
    texts = TEXTS + [None] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(3, TEXTS[3], "again", 7), (None, "no id here", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _cut int")
    done = fill_in_middle(docs)
    got = done.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(got, key=str) == sorted([(r[0], *transformed(r[0], r[1]), r[1] or "") for r in rows], key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["char", "byte"])
def test_other_units_rates_and_sentinels_restore_the_text(spark, unit):
    sentinels = ("[pre]", "[.*]", "[mid]")
    docs = spark.createDataFrame([(i, f"é{i} 漢字 [pr [.* {'ab ' * i}") for i in range(60)], "doc_id long, text string")
    done = fill_in_middle(docs, unit=unit, rate=100, suffix_first=50, sentinels=sentinels)
    rows = done.withColumn("back", restored(F.col("output"), F.col("form"), sentinels)).join(docs, "doc_id").collect()
    assert all(r.back == r.text and r.output != r.text for r in rows) and {r.form for r in rows} == {"psm", "spm"}


def test_sentinels_that_would_be_ambiguous_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "P", "<M>"), ("ab", "bc", "x"), ("aXa", "s", "m")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="line")


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    frame = con.execute(fm.OP11_SQL)
    names = [c[0] for c in frame.description]
    assert sorted(tuple(r) for r in fm.op11_fill_in_middle(spark, sf).select(*names).collect()) == sorted(frame.fetchall())
