"""The stream of latest rows: any order of files, repeated rows, crashes before and after a commit, late rows."""

import datetime as dt
import random

import pytest

from corpusloom.operators.spine import keep_latest
from corpusloom.streaming import upsert
from corpusloom.streaming.upsert import UpsertTable, upsert_files

SCHEMA = "user_id long, event_id long, ts timestamp, value string"
START = dt.datetime(2024, 1, 1)


def rows_of(seed, n=120, keys=15):
    rng = random.Random(seed)
    rows = [(rng.randrange(keys), i, START + dt.timedelta(minutes=rng.randrange(3000)), f"v{i}") for i in range(n)]
    rows += rng.sample(rows, 20)  # delivered twice
    rows += [(3, 500, None, "no time"), (99, 501, None, "only without time"), (None, 502, START, "no key"), (7, 503, START + dt.timedelta(days=9), "tie a"), (7, 504, START + dt.timedelta(days=9), "tie b"), (98, 505, START - dt.timedelta(days=99), "late and first")]
    return rows


def write(spark, folder, rows, files, order):
    """One file for each part; the stream takes them by modification time, so they are written in that order."""
    for k in order:
        part = rows[k::files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def expected(spark, rows):
    return {tuple(r) for r in keep_latest(spark.createDataFrame(rows, SCHEMA).where("user_id IS NOT NULL"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "value").collect()}


def table_of(spark, path, buckets=4):
    return UpsertTable(spark, str(path), SCHEMA, "user_id", "ts", "event_id", buckets=buckets)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_any_order_gives_the_latest_rows(spark, tmp_path, order):
    rows = rows_of(1)
    write(spark, str(tmp_path / "in"), rows, 4, order)
    table = table_of(spark, tmp_path / "table")
    upsert_files(table, str(tmp_path / "in"), str(tmp_path / "ck"))
    assert {tuple(r) for r in table.read().select("user_id", "event_id", "ts", "value").collect()} == expected(spark, rows)
    notes = [table.commit_of(b) for b in table.batches()]
    assert len(notes) >= 4 and sum(n["keyless"] for n in notes) == 1
    more = [(5, 900, START + dt.timedelta(days=50), "later"), (98, 901, START - dt.timedelta(days=98), "late again")]
    write(spark, str(tmp_path / "in"), more, 1, [0])
    upsert_files(table, str(tmp_path / "in"), str(tmp_path / "ck"))
    assert {tuple(r) for r in table.read().select("user_id", "event_id", "ts", "value").collect()} == expected(spark, rows + more)
    assert table.commit_of(table.batches()[-1])["late"] + sum(n["late"] for n in notes) >= 1


@pytest.mark.parametrize("after", [False, True])
def test_killed_midway(spark, tmp_path, monkeypatch, after):
    """The second batch dies before or after its note is written; the next run repeats it and ends with the same table."""
    rows = rows_of(2)
    write(spark, str(tmp_path / "in"), rows, 4, range(4))
    table = table_of(spark, tmp_path / "table")
    commit = UpsertTable._commit
    died = []

    def dying(self, batch, note):
        if batch == 1 and not died:
            died.append(batch)
            if after:
                commit(self, batch, note)
            raise RuntimeError("killed")
        commit(self, batch, note)

    monkeypatch.setattr(UpsertTable, "_commit", dying)
    with pytest.raises(Exception, match="killed"):
        upsert_files(table, str(tmp_path / "in"), str(tmp_path / "ck"))
    assert died and table.batches() == ([0, 1] if after else [0])
    upsert_files(table, str(tmp_path / "in"), str(tmp_path / "ck"))
    assert {tuple(r) for r in table.read().select("user_id", "event_id", "ts", "value").collect()} == expected(spark, rows)


def test_a_batch_counts_once_and_untouched_buckets_stay(spark, tmp_path):
    table = table_of(spark, tmp_path / "table", buckets=64)
    one = spark.createDataFrame([(1, 1, START, "a"), (2, 1, START, "b")], SCHEMA)
    assert table.upsert(one, 0) and not table.upsert(spark.createDataFrame([(1, 9, START, "again")], SCHEMA), 0)
    assert table.upsert(spark.createDataFrame([(1, 2, START, "newer"), (1, 0, START, "older")], SCHEMA), 1)
    assert {(r.user_id, r.value) for r in table.read().collect()} == {(1, "newer"), (2, "b")}
    where = table.commit_of(1)["buckets"]
    assert sorted(where.values()) == [0, 1]
    table.upsert(spark.createDataFrame([(2, 5, START, "c")], SCHEMA), 2)
    table.forget(1)
    assert table.batches() == [2] and {(r.user_id, r.value) for r in table.read().collect()} == {(1, "newer"), (2, "c")}
    assert table_of(spark, tmp_path / "none").read().count() == 0


def test_rows_that_change_nothing_are_not_passed_on(spark, tmp_path):
    rows = rows_of(3)
    write(spark, str(tmp_path / "in"), rows, 2, range(2))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = upsert.latest_changes(stream, "user_id", "ts", "event_id").writeStream.foreachBatch(lambda df, b: seen.append(df.select("user_id", "ts", "late").collect())).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    best = {}
    for batch in seen:
        for r in batch:
            assert r.user_id not in best or best[r.user_id] is None or (r.ts is not None and r.ts >= best[r.user_id])
            best[r.user_id] = r.ts
    assert len(best) == len({r[0] for r in rows})


def test_a_part_meets_its_state_at_once_and_whole_numbers_stay(spark, tmp_path, monkeypatch):
    """Python is called once a part and batch, not once a key; ids beyond 2**53 beside nulls come back as they were."""
    big = 2**60 + 1
    rows = [(big + i, None if i % 3 else big + 2 * i, None if i % 7 == 0 else START + dt.timedelta(minutes=i, microseconds=1), None if i % 5 else f"v{i}") for i in range(300)] + [(None, big, START, "no key")]
    write(spark, str(tmp_path / "in"), rows, 1, [0])
    calls = spark.sparkContext.accumulator(0)
    real = upsert.newer

    def counted(*args):
        run = real(*args)

        def one(key, frames, state):
            calls.add(1)
            yield from run(key, frames, state)

        return one

    monkeypatch.setattr(upsert, "newer", counted)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    seen = []
    upsert.latest_changes(stream, "user_id", "ts", "event_id").writeStream.foreachBatch(lambda df, b: seen.extend(df.collect())).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert {tuple(r)[:4] for r in seen} == set(rows) and len(seen) == len(rows)
    assert 0 < calls.value <= upsert.PARTS + 1
