"""From text files under their layouts to the movement file."""

import pytest
from pyspark.sql import functions as F

from lifetrack.plans.movement_table import movement_table
from lifetrack.sources import adapters, files, layouts
from lifetrack.session import settle
from tests import histories as h

PLACES = {"A": 1, "B": 2, "C": 3, "D": 4, "-3": -3}


def european(day: str) -> str:
    return "/".join(reversed(day.split("-")))


@pytest.fixture()
def folder(tmp_path, spark):
    starts = {r.period: (str(r.period_start), str(r.period_end)) for r in h.periods(spark).collect()}

    def write(name, role, rows):
        layout = adapters.ROLES[role][0] if role in adapters.ROLES else role
        header = [c.strip().split(" ")[0] for c in layout.split(",")]
        lines = [",".join(header)] + [",".join("NA" if r.get(c) is None else str(r[c]) for c in header) for r in rows]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")

    dates = lambda p: {"PeriodStart": european(starts[p][0]), "PeriodEnd": european(starts[p][1])}
    write("residency", "residency", [
        {"BirdID": e, "TerritoryID": PLACES[place], "Status": s, "FieldPeriodID": p, **dates(p)} for e, place, s, p in h.HISTORY])
    write("periods", "periods", [{"FieldPeriodID": p, "Island": "X", **dates(p)} for p in starts])
    write("births", "births", [{"BirdID": e, "BirthDate": european(d), "BirthDateEstimated": "false"} for e, d in h.BIRTHS.items()])
    thirds = [[s for i, s in enumerate(h.SIGHTINGS) if i % 3 == k] for k in range(3)]
    write("observations", "observations", [
        {"ObservationID": 1, "BirdID": e, "ObservationFieldPeriodID": p, "ObservationDate": european(d), "TerritoryID": PLACES[x]}
        for e, p, d, x in thirds[0]])
    write("catches", "catches", [
        {"BirdID": e, "FieldPeriodID": p, "OccasionDate": european(d), "TerritoryID": PLACES[x]} for e, p, d, x in thirds[1]])
    write("nest_watches", "nest_watches", [
        {"BirdID": e, "FieldPeriodID": p, "WatchDate": european(d), "TerritoryID": PLACES[x]} for e, p, d, x in thirds[2]])
    return str(tmp_path)


def test_from_text_to_the_movement_file(spark, folder, tmp_path):
    read = {r: adapters.read_role(spark, f"{folder}/{r}.csv", r) for r in (
        "residency", "periods", "births", "observations", "catches", "nest_watches")}
    seen = adapters.sightings(read["observations"], read["catches"], read["nest_watches"])
    assert seen.count() == len(h.SIGHTINGS)
    table = movement_table(adapters.with_tie(read["residency"]), seen, read["periods"], read["births"], exclude_periods=[110])
    files.write_csv(files.to_movement_file(settle(table)), f"{folder}/movement")
    back = spark.read.option("header", True).option("nullValue", "NA").csv(f"{folder}/movement")
    assert back.columns == list(layouts.MOVEMENT_FILE_COLUMNS) and len(back.columns) == 23
    number = F.create_map(*[F.lit(x) for k, v in PLACES.items() for x in (k, v)])
    history = h.residency(spark).withColumn("location", number[F.col("location")])
    places = h.sightings(spark).withColumn("location", number[F.col("location")])
    plain = movement_table(history, places, h.periods(spark), h.births(spark), exclude_periods=[110])
    want = sorted((str(r.entity), str(r.origin), r.moved, r.method, None if r.event_date is None else str(r.event_date)) for r in plain.collect())
    got = sorted((r.BirdID, r.NatalTerritory, r.Disperse, r.Method, r.DispersalDate) for r in back.collect())
    assert got == want


@pytest.mark.parametrize("role", list(adapters.ROLES))
def test_every_layout_has_a_reader(spark, role, tmp_path):
    layout, names = adapters.ROLES[role]
    header = [c.strip().split(" ")[0] for c in layout.split(",")]
    (tmp_path / "one.csv").write_text(",".join(header) + "\n" + ",".join(["NA"] * len(header)) + "\n")
    row = adapters.read_role(spark, str(tmp_path / "one.csv"), role).collect()
    assert len(row) == 1 and set(row[0].asDict()) == set(names) and not any(row[0].asDict().values())
