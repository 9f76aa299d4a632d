"""From file layouts to the canonical tables that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.movement import all_sightings
from . import layouts
from .files import read_csv

PERIOD_DATES = {"period_start": "PeriodStart", "period_end": "PeriodEnd"}
#: Role: its layout, and canonical column names against the file's.
ROLES = {
    "residency": (layouts.RESIDENCY, {
        "entity": "BirdID", "location": "TerritoryID", "status": "Status", "period": "FieldPeriodID", **PERIOD_DATES}),
    "periods": (layouts.PERIODS, {"period": "FieldPeriodID", "island": "Island", **PERIOD_DATES}),
    "parentage": (layouts.PARENTAGE, {
        "entity": "id", "location": "mum_TerrID", "period": "FPID", "p": "p", **PERIOD_DATES}),
    "observations": (layouts.OBSERVATIONS, {
        "entity": "BirdID", "period": "ObservationFieldPeriodID", "date": "ObservationDate", "location": "TerritoryID"}),
    "catches": (layouts.CATCHES, {
        "entity": "BirdID", "period": "FieldPeriodID", "date": "OccasionDate", "location": "TerritoryID"}),
    "nest_watches": (layouts.NEST_WATCHES, {
        "entity": "BirdID", "period": "FieldPeriodID", "date": "WatchDate", "location": "TerritoryID"}),
    "births": (layouts.BIRTHS, {
        "entity": "BirdID", "birth_date": "BirthDate", "birth_period": "BirthFieldPeriodID", "estimated": "BirthDateEstimated"}),
    "nests": (layouts.NESTS, {
        "nest_id": "NestID", "nest_number": "NestNumber", "location": "TerritoryID", "period": "FieldPeriodID",
        "hatch_date": "HatchDateLatest", "fledge_date": "FledgeDateLatest"}),
    "chicks": (layouts.CHICKS, {"entity": "BirdID", "nest_id": "NestID", "hatch_date": "HatchDate"}),
    "assays": (layouts.ASSAYS, {
        "entity": "BirdID", "environment_score": "EnvironmentScore", "object_score": "ObjectScore", "date": "OccasionDate"}),
    "statuses": (layouts.GROUP_STATUS, {
        "entity": "BirdID", "period": "FieldPeriodID", "location": "TerritoryID", "status": "Status", "island": "Island"}),
    "measurements": (layouts.MEASUREMENTS, {
        "location": "TerritoryID", "period": "FieldPeriodID", "easting": "Easting", "northing": "Northing",
        "method": "SizeMethod", "size": "TerritorySize", "island": "Island"}),
    "quality": (layouts.QUALITY, {
        "year": "Year", "period": "FieldPeriodID", "location": "TerritoryID", "quality": "TQcorrected",
        "food": "SumVeg_X_Inverts", "island": "Island"}),
    "summer_index": (layouts.SUMMER_INDEX, {
        "location": "TerritoryID", "period": "FieldPeriodID", "season_index": "SummerIndex", **PERIOD_DATES}),
    "insects": (layouts.INSECTS, {
        "year": "Year", "period": "FieldPeriodID", "value": "MeanInsects2", "island": "Island"}),
    "blood_tests": (layouts.BLOOD_TESTS, {
        "entity": "BirdID", "period": "FieldPeriodID", "result": "MalariaConsensus", "date": "OccasionDate", "n_tests": "Ntests"}),
    "sex": (layouts.SEX, {"entity": "BirdID", "sex": "SexEstimate"}),
}


def canonical(raw: DataFrame, role: str) -> DataFrame:
    """The columns of a role under their canonical names; other columns of the file are left out."""
    return raw.select(*[F.col(theirs).alias(ours) for ours, theirs in ROLES[role][1].items()])


def read_role(spark: SparkSession, path: str, role: str, **options) -> DataFrame:
    """Read the file of a role under its layout and name its columns; ``options`` are those of ``read_csv``."""
    return canonical(read_csv(spark, path, ROLES[role][0], **options), role)


def with_tie(table: DataFrame) -> DataFrame:
    """Add a number that tells rows apart, from their content."""
    return table.withColumn("tie", F.xxhash64(*table.columns))


def sightings(observations: DataFrame, catches: DataFrame, nest_watches: DataFrame) -> DataFrame:
    """All ways of having been seen, as one table of entity, period, date and location."""
    return all_sightings(observations, catches, nest_watches)
