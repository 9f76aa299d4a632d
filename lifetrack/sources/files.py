"""CSV and Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import settle
from .layouts import MOVEMENT_FILE_COLUMNS


#: How files spell unknown values and dates.
OPTIONS = {"nullValue": "NA", "dateFormat": "dd/MM/yyyy"}


def parse_csv(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Lines of text under a declared schema by the rules of the file reader."""
    parsed = F.from_csv(column, schema, {**OPTIONS, "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("row")).select("row.*")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    *,
    date_format: str = OPTIONS["dateFormat"],
    leading_index: bool = False,
) -> DataFrame:
    """Read a headed CSV under a declared schema; ``NA`` and blanks are null.

    The header must spell the schema's columns in order, so a changed file
    fails instead of shifting columns. ``leading_index`` skips an unnamed
    row-number column at the front.
    """
    reader = spark.read.option("header", True).option("nullValue", OPTIONS["nullValue"])
    reader = reader.option("dateFormat", date_format)
    if leading_index:
        return reader.schema(f"row_index string, {schema}").csv(path).drop("row_index")
    return reader.schema(schema).csv(path, enforceSchema=False)


#: Where a line stands that does not fit its schema, and what its rejected row says of a wrong number of fields.
CORRUPT, FIELDS = "_corrupt_line", "(fields)"


def _bad_columns(line: Column, schema: StructType, options: dict[str, str]) -> Column:
    """Names of the columns whose text in ``line`` is known but has no value of the column's type, in order."""
    read = lambda kind: F.from_csv(
        line, ", ".join(f"`{f.name}` {kind or f.dataType.simpleString()}" for f in schema), {**options, "mode": "PERMISSIVE"})
    texts, values = read("string"), read("")
    wrong = [F.when(texts[f.name].isNotNull() & values[f.name].isNull(), F.lit(f.name)) for f in schema]
    return F.filter(F.array(*wrong), lambda c: c.isNotNull())


def split_rejects(parsed: DataFrame, schema: str, options: Mapping[str, str] = OPTIONS) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects: ``file`` (if known), ``line``, ``columns`` that have no value of their type.

    ``parsed`` has the schema's columns and the text of each line that does not fit in ``CORRUPT``. A line with too many
    or too few fields and no bad value names ``FIELDS``. Each line is in one of both tables.
    """
    kinds = StructType.fromDDL(schema)
    good = parsed.where(F.col(CORRUPT).isNull()).select(*kinds.names)
    bad = _bad_columns(F.col(CORRUPT), kinds, dict(options))
    named = F.when(F.size(bad) == 0, F.array(F.lit(FIELDS))).otherwise(bad)
    where_from = ["file"] if "file" in parsed.columns else []
    return good, parsed.where(F.col(CORRUPT).isNotNull()).select(*where_from, F.col(CORRUPT).alias("line"), named.alias("columns"))


def parse_csv_with_rejects(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines of text under a declared schema, and the lines that do not fit it: see ``split_rejects``."""
    parsed = F.from_csv(column, f"{schema}, {CORRUPT} string", {**OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return split_rejects(lines.select(parsed.alias("row")).select("row.*"), schema)


def read_csv_with_rejects(
    spark: SparkSession, path: str, schema: str, *, date_format: str = OPTIONS["dateFormat"]
) -> tuple[DataFrame, DataFrame]:
    """``read_csv``, with the lines that do not fit the schema as a table of their own: see ``split_rejects``.

    The header is not compared with the schema here, as only whole files can be refused. The lines are parsed once, in
    all columns whatever is selected later, and settled: two readings of a file might not agree.
    """
    options = {"header": "true", "nullValue": OPTIONS["nullValue"], "dateFormat": date_format}
    reader = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false")
    parsed = reader.schema(f"{schema}, {CORRUPT} string").csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    return split_rejects(settle(parsed), schema, {k: v for k, v in options.items() if k != "header"})


def write_csv(df: DataFrame, path: str) -> None:
    """Write a headed CSV folder with nulls as ``NA`` and no row numbers."""
    df.write.mode("errorifexists").csv(path, header=True, nullValue="NA")


def to_movement_file(movement: DataFrame) -> DataFrame:
    """The movement table under the column names and order of its file."""
    return movement.select(
        *[F.col(ours).alias(theirs) for theirs, ours in MOVEMENT_FILE_COLUMNS.items()]
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
