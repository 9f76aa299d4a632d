"""Column layouts of the survey files, by role.

Declared once so that files are read with explicit types and every column is
addressed by name. Dates in the files are ``dd/MM/yyyy`` text.
"""

from __future__ import annotations

# File layouts (name, type), in file order.
RESIDENCY = "BirdID int, TerritoryID int, Status string, FieldPeriodID int, PeriodStart date, PeriodEnd date"
PERIODS = (
    "FieldPeriodID int, Island string, PeriodStart date, PeriodEnd date, "
    "EarliestEligibleDate date, LatestEligibleDate date, PeriodYear int, Year int, "
    "Period int, MergeRef int, MergeStatus string"
)
PARENTAGE = (
    "mum_FPID string, id int, mum int, dad int, p double, FPID int, PeriodStart date, "
    "PeriodEnd date, O_TerrNum string, O_TerrID int, dad_FPID string, MumStatus string, "
    "mum_TerrNum string, mum_TerrID int"
)
OBSERVATIONS = (
    "ObservationID int, BirdID int, ObservationFieldPeriodID int, ObservationDate date, "
    "TerritoryID int, Remarks string"
)
CATCHES = "BirdID int, FieldPeriodID int, OccasionDate date, TerritoryID int"
NEST_WATCHES = "BirdID int, FieldPeriodID int, WatchDate date, TerritoryID int"
BIRTHS = "BirdID int, BirthDate date, BirthFieldPeriodID int, BirthDateEstimated boolean"
NESTS = (
    "NestID int, NestNumber int, TerritoryID int, FieldPeriodID int, "
    "HatchDateLatest date, FledgeDateLatest date"
)
CHICKS = "BirdID int, NestID int, HatchDate date"
ASSAYS = "BirdID int, EnvironmentScore double, ObjectScore double, OccasionDate date"
GROUP_STATUS = "Island string, BirdID int, FieldPeriodID int, TerritoryID int, Status string"
MEASUREMENTS = (
    "Island string, TerritoryID int, FieldPeriodID int, Easting double, Northing double, "
    "SizeMethod string, TerritorySize double"
)
QUALITY = (
    "Island string, Year int, FieldPeriodID int, TerritoryID int, TQcorrected double, "
    "SumVeg_X_Inverts double"
)
SUMMER_INDEX = (
    "TerritoryID int, FieldPeriodID int, PeriodStart date, PeriodEnd date, SummerIndex double"
)
INSECTS = "Island string, Year int, FieldPeriodID int, MeanInsects2 double"
BLOOD_TESTS = (
    "BirdID int, BloodID int, FieldPeriodID int, OccasionDate date, MalariaConsensus int, "
    "Mismatches int, Ntests int"
)
SEX = "BirdID int, SexEstimate int"

# Column names of the movement table as files carry them,
# in file order, against the names used here.
MOVEMENT_FILE_COLUMNS = {
    "BirdID": "entity",
    "NatalTerritory": "origin",
    "LastFPIDNatal": "last_period",
    "LastFPIDNatalPeriodStart": "last_start",
    "LastFPIDNatalPeriodEnd": "last_end",
    "SecondLastFPIDNatal": "second_last_period",
    "SecondLastFPIDNatalPeriodStart": "second_last_start",
    "SecondLastFPIDNatalPeriodEnd": "second_last_end",
    "Inherit": "inherit",
    "Disperse": "moved",
    "Prior_dispersal": "tested_before",
    "Method": "method",
    "DispersalDate": "event_date",
    "DispersalMonth": "event_month",
    "DispersalMonth2": "event_season",
    "DisperseStatus": "dest_status",
    "DisperseStatus2": "dest_dominance",
    "DispersePeriodStart": "dest_start",
    "DispersePeriodEnd": "dest_end",
    "DisperseTerritoryID": "dest_location",
    "DisperseFPID": "dest_period",
    "NatalStatus": "origin_status",
    "NatalStatus2": "origin_dominance",
}
