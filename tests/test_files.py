import datetime as dt
from pathlib import Path

import pytest

from lifetrack.sources import files, layouts
from lifetrack.session import settle


def test_csv_reads_typed_columns_and_nulls(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        "BirdID,TerritoryID,Status,FieldPeriodID,PeriodStart,PeriodEnd\n"
        "1,-3,FLOAT,10,01/02/2003,28/02/2003\n2,NA,,NA,NA,31/04/2003\n"
    )
    a, b = files.read_csv(spark, str(path), layouts.RESIDENCY).orderBy("BirdID").collect()
    assert (a.TerritoryID, a.PeriodStart) == (-3, dt.date(2003, 2, 1))
    assert (b.TerritoryID, b.Status, b.FieldPeriodID, b.PeriodEnd) == (None, None, None, None)


def test_changed_header_fails(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("BirdID,Status,TerritoryID,FieldPeriodID,PeriodStart,PeriodEnd\n1,FL,2,3,01/02/2003,01/02/2003\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(path), layouts.RESIDENCY).collect()


def test_lone_carriage_returns_and_quoted_commas(spark, tmp_path):
    path = tmp_path / "cr.csv"
    path.write_bytes(b'Island,Year,FieldPeriodID,MeanInsects2\r"CN, north",2001,5,1.5\rCN,2002,6,NA\n')
    rows = files.read_csv(spark, str(path), layouts.INSECTS).orderBy("Year").collect()
    assert [(r.Island, r.MeanInsects2) for r in rows] == [("CN, north", 1.5), ("CN", None)]


def test_leading_row_numbers_are_dropped(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text('"","BirdID","SexEstimate"\n"1",5,1\n"2",6,NA\n')
    df = files.read_csv(spark, str(path), layouts.SEX, leading_index=True)
    assert df.columns == ["BirdID", "SexEstimate"]
    assert sorted(tuple(r) for r in df.collect()) == [(5, 1), (6, None)]


def test_write_then_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, None)], layouts.SEX)
    target = str(tmp_path / "out")
    files.write_csv(df, target)
    assert sorted(tuple(r) for r in files.read_csv(spark, target, layouts.SEX).collect()) == [(1, 1), (2, None)]
    with pytest.raises(Exception):
        files.write_csv(df, target)


def test_settle_writes_into_the_named_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("lifetrack-*/*.parquet"))
    df = settle(spark.range(10).selectExpr("id * 2 as x"))
    assert set(folder.glob("lifetrack-*/*.parquet")) - before
    assert df.agg({"x": "sum"}).first()[0] == 90


def test_lines_that_do_not_fit_are_rejected(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "BirdID,TerritoryID,Status,FieldPeriodID,PeriodStart,PeriodEnd\n"
    (tmp_path / "in/a.csv").write_text(head + "1,-3,FLOAT,10,01/02/2003,28/02/2003\nx,2,B,y,01/02/2003,31/04/2003\n3,NA,,NA,NA,\n")
    (tmp_path / "in/b.csv").write_text(head + "4,1,B,1,01/02/2003\n5,1,B,1,01/02/2003,01/02/2003,more\n6,1,\"B, C\",1,01/02/2003,01/02/2003\n")
    good, rejects = files.read_csv_with_rejects(spark, str(tmp_path / "in"), layouts.RESIDENCY)
    assert sorted(r.BirdID for r in good.collect()) == [1, 3, 6]
    assert good.where("BirdID = 6").first().Status == "B, C"
    got = {(r.file.rsplit("/", 1)[1], r.line.split(",")[0]): r["columns"] for r in rejects.collect()}
    assert got == {("a.csv", "x"): ["BirdID", "FieldPeriodID", "PeriodEnd"], ("b.csv", "4"): [files.FIELDS], ("b.csv", "5"): [files.FIELDS]}
    # A bad value counts even where only another column is read.
    assert good.select("Status").count() + rejects.select("file").count() == 6
