"""The CSV data source against Python's csv on whole files."""

from __future__ import annotations

import csv
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.sources import panel_csv, readers


def write(path, rng, rows, columns, junk):
    names = [f"c{i}" for i in range(columns)]
    names[rng.randrange(columns // 2)], names[-1], names[columns // 2] = "date", "adj_close", "volume"
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(names)
        for k in range(rows):
            row = {n: rng.choice(junk) for n in names} | {"date": str(date(2020, 1, 1) + timedelta(k)), "adj_close": f"{k}.5", "volume": rng.choice(["7", "n/a", ""])}
            writer.writerow([row[n] for n in names])


def plain(folder):
    out = []
    for path in folder.glob("*.csv"):
        with path.open(newline="", encoding="utf-8-sig") as f:
            for r in csv.DictReader(f):
                number = lambda v: float(v) if v not in ("n/a", "", None) else None
                out.append((path.stem, date.fromisoformat(r["date"]), number(r["adj_close"]), number(r["volume"])))
    return sorted(out, key=str)


JUNK = ["", "x", "a, b", 'say "so"', "two\nlines", '"', 'ends"', "\n", "2020-01-02,1,2\n2020-01-03,4,5", "é" * 30, '""', ",\n,"]


@pytest.mark.parametrize("split", [1 << 26, 257, 64, 5])
def test_wide_files_quoted_breaks_and_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    for k, (rows, columns) in enumerate([(30, 200), (40, 6), (3, 68), (25, 6), (0, 6), (1, 6)]):
        write(tmp_path / f"T{k}.csv", rng, rows if split > 60 else min(rows, 9), columns if split > 60 else 6, JUNK)
    (tmp_path / "Q.csv").write_text('date,adj_close,volume\n2020-01-01,"1",2\n2020-01-02,3,"4"')
    got = readers.read_daily_csv(spark, str(tmp_path), split_bytes=split)
    assert sorted(map(tuple, got.collect()), key=str) == plain(tmp_path)


def test_columns_beyond_any_number(spark, tmp_path):
    (tmp_path / "A.csv").write_text(",".join([f"c{i}" for i in range(67)] + ["adj_close", "date"]) + "\n" + ",".join(["0"] * 67 + ["1.5", "2020-01-02"]) + "\n")
    assert [tuple(r) for r in readers.read_daily_csv(spark, str(tmp_path), columns=("adj_close",)).collect()] == [("A", date(2020, 1, 2), 1.5)]


def test_filters_reach_the_scan(spark, tmp_path, capfd):
    rng = random.Random(1)
    for t in "ABC":
        write(tmp_path / f"{t}.csv", rng, 20, 6, ["x"])
    df = readers.read_daily_csv(spark, str(tmp_path)).filter((F.col("ticker") == "B") & (F.col("date") >= "2020-01-10") & (F.col("date") < "2020-01-12"))
    assert sorted(r.date.day for r in df.collect()) == [10, 11]
    df.explain("formatted")
    shown = capfd.readouterr().out
    assert "Filter" not in shown.replace("PushedFilters", "") or "ticker" not in "".join(x for x in shown.splitlines() if x.startswith("Condition"))
    reader = panel_csv.PanelReader({"path": str(tmp_path), "columns": "[]"}, readers.PANEL_SCHEMA)
    left = list(reader.pushFilters([panel_csv.In(("ticker",), ("A", "C")), panel_csv.EqualTo(("ticker",), "A"), panel_csv.GreaterThan(("date",), date(2020, 1, 3)), panel_csv.EqualTo(("adj_close",), "1")]))
    assert len(left) == 1 and [p.path.rsplit("/", 1)[1] for part in reader.partitions() for p in part.pieces] == ["A.csv"] and reader.tests == [(">", date(2020, 1, 3))]


def test_small_files_are_packed_and_long_ones_cut():
    mb = 1 << 20
    files = [(f"f{i}.csv", 1000) for i in range(200)] + [("long.csv", 5120 * mb)]
    parts = panel_csv.planned(files, 64 * mb, {("long.csv", 64 * mb)})
    assert sum(len(p) for p in parts) == 200 + 80 and len(parts) <= 85 and max(len(p) for p in parts) > 50
    cut = [p for part in parts for p in part if p.path == "long.csv"]
    assert [p.start for p in cut] == [i * 64 * mb for i in range(80)] and cut[-1].end == 5120 * mb and [p.inside for p in cut] == [k == 1 for k in range(80)]


def test_bad_files_are_listed(spark, tmp_path):
    (tmp_path / "A.csv").write_text("date,adj_close\n2020-01-02,1\n2020-13-02,1\n2020-1-3,nan\n")
    (tmp_path / "B.csv").write_text("day,adj_close\n2020-01-02,1\n")
    (tmp_path / "C.csv").write_text("")
    (tmp_path / "D.csv").write_text("date,adj_close\n2020-01-02,x\n")
    (tmp_path / "E.csv").write_text("date,adj_close\nno,1\n")
    found = {r.ticker: (r.n_rows, r.n_usable, r.problem) for r in readers.scan_files(spark, str(tmp_path)).collect()}
    assert found == {"A": (2, 1, None), "B": (0, 0, "no date column"), "C": (0, 0, "empty"), "D": (1, 0, "no prices"), "E": (0, 0, "no dates")}
    assert readers.read_daily_csv(spark, f"{tmp_path}/nothing").count() == 0


def test_dates():
    cases = {"2020-01-02": date(2020, 1, 2), "2020-1-2 10:00": date(2020, 1, 2), "2020-01-02T09": date(2020, 1, 2), " 2020-02 ": date(2020, 2, 1), "2020": date(2020, 1, 1), "2020-02-30": None, "x": None, "": None, "01/02/2020": None}
    assert {k: panel_csv.iso_date(k) for k in cases} == cases


def test_files_by_ticker_come_back(spark, tmp_path):
    rows = [(t, date(2020, 1, 1) + timedelta(i), None if i == 3 else i / 7, float(i)) for t in ("A", "B, x", 'say "C"') for i in range(30)]
    daily = spark.createDataFrame(rows, "ticker string, date date, adj_close double, volume double")
    for _ in range(2):
        readers.write_daily_csv(daily.repartition(5), f"{tmp_path}/d")
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["A.csv", "B, x.csv", 'say "C".csv']
    assert sorted(map(tuple, readers.read_daily_csv(spark, f"{tmp_path}/d").collect()), key=str) == sorted(rows, key=str)
    with pytest.raises(Exception, match="no name of a file"):
        readers.write_daily_csv(spark.createDataFrame([("D", date(2020, 1, 1), 1.0), ("a/b", date(2020, 1, 1), 1.0)], "ticker string, date date, adj_close double").coalesce(1), f"{tmp_path}/d")
    assert "D.csv" not in {p.name for p in (tmp_path / "d").iterdir()}
