"""Scans that name what they could not read."""

from pathlib import Path

from corpusloom.sources.tolerant import json_report, scan_report, tolerant_table


def test_broken_files_are_named_with_their_size(spark, tmp_path):
    base = tmp_path / "in"
    for year in (2020, 2021):
        spark.range(100).selectExpr("id", "concat('text ', id) AS text").repartition(2).write.parquet(str(base / f"year={year}"))
    spark.range(0).selectExpr("id", "'x' AS text").write.parquet(str(base / "none"))
    files = sorted(base.rglob("*.parquet"))
    whole = next(f for f in files if "2020" in str(f))
    data = whole.read_bytes()
    (base / "cut.parquet").write_bytes(data[: len(data) // 2])
    (base / "zero.parquet").write_bytes(b"")
    (base / "noise.parquet").write_bytes(b"PAR1" + b"?" * 300 + b"PAR1")
    (base / "notes.txt").write_text("not a table")
    rows = tolerant_table(spark, str(base), "id long, text string")
    assert rows.count() == 200 and rows.select("source_file").distinct().count() == 4
    report = {Path(r.path).name: r for r in scan_report(spark, rows, str(base)).collect()}
    assert {n for n, r in report.items() if r.status == "broken"} == {"cut.parquet", "noise.parquet", "zero.parquet"}
    assert all(r.reason and r.rows == 0 for r in report.values() if r.status == "broken")
    assert report["cut.parquet"].bytes == len(data) // 2 and report["noise.parquet"].bytes == 308
    assert sum(r.status == "empty" for r in report.values()) == len(list((base / "none").glob("*.parquet")))
    assert sum(r.rows for r in report.values()) == 200 and "notes.txt" not in report
    small = {Path(r.path).name: r.status for r in scan_report(spark, rows, str(base), opened=100).collect()}
    assert small["cut.parquet"] == "unread" and small["zero.parquet"] == "broken"


def test_json_lines_that_do_not_parse_are_counted(spark, tmp_path):
    base = tmp_path / "lines"
    base.mkdir()
    (base / "a.json").write_text('{"id": 1}\n{"id": \n\n{"id": 3}\n')
    (base / "b.json").write_text("nothing\n")
    (base / "c.json").write_text("")
    report = {Path(r.path).name: (r.bytes, r.rows, r.bad) for r in json_report(spark, str(base), "id long").collect()}
    assert report == {"a.json": ((base / "a.json").stat().st_size, 2, 1), "b.json": (8, 0, 1), "c.json": (0, 0, 0)}
