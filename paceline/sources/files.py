"""File readers: roster and starter-list CSV, annotation JSON, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.clean import file_stem
from ..operators.results import require_columns
from ..plans.ordered import ordered_index

# Header names of the roster file (lower case) and their columns.
ROSTER_HEADERS = {
    "bibnumber": "bib_number",
    "racername": "racer_name",
    "gender": "gender",
    "team": "team",
    "age": "age",
}
REPLACEMENT = "�"


def _checked(c: Column) -> Column:
    """The text, failing the read when bytes were not UTF-8."""
    broken = F.contains(c, F.lit(REPLACEMENT))
    return F.when(broken, F.raise_error(F.lit("File must be UTF-8 encoded"))).otherwise(c)


def read_roster(
    spark: SparkSession, path: str, race_id: int = 0, multi_line: bool = True
) -> DataFrame:
    """Roster CSV with row numbers from 2, counted per file, and ``file_no``.

    Header names match in any case.  ``multi_line`` allows line breaks inside
    quotes, and reads each file in one task; without it large files split, and
    rows are numbered over (block start, position in block).
    """
    if not path.endswith((".csv", "/")) and "*" not in path:
        raise ValueError("File must be a CSV file")
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .csv(path)
    )
    names = {c.strip().lower(): c for c in raw.columns}
    require_columns(
        raw.select(*[F.col(f"`{names[h]}`").alias(h) for h in names if h in ROSTER_HEADERS]),
        {"bibnumber", "racername"},
    )
    cells = [
        (_checked(F.col(f"`{names[h]}`")) if h in names else F.lit(None).cast("string")).alias(c)
        for h, c in ROSTER_HEADERS.items()
    ]
    rows = raw.select(
        F.lit(race_id).cast("bigint").alias("race_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        *cells,
    )
    return with_row_num(rows)


def with_row_num(rows: DataFrame) -> DataFrame:
    """Number the files from 0, and the rows of each from 2 (the header is row 1)."""
    numbered = numbered_lines(rows)
    return numbered.withColumn("row_num", F.col("_n") + 1).drop("_n", "_file", "_block", "_at")


def numbered_lines(rows: DataFrame) -> DataFrame:
    """Add ``file_no`` from 0, in the order of names, and ``_n`` from 1 in each file.

    ``rows`` come with ``_file``, ``_block`` (where the part read began) and ``_at``
    (a growing number within it).
    """
    order = [F.col("_block").asc(), F.col("_at").asc()]
    numbered = ordered_index(rows, ["_file"], order, "_n")
    names = rows.select("_file").distinct().withColumn("_all", F.lit(0))
    names = ordered_index(names, ["_all"], [F.col("_file").asc()], "_f")
    return numbered.join(names.select("_file", (F.col("_f") - 1).alias("file_no")), "_file")


def read_starter_list(spark: SparkSession, path: str) -> DataFrame:
    """Starter list with typed bib and age; other columns of the file are ignored."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, {"Bib", "First Name", "Last Name", "Gender", "Age"})
    return raw.select(
        F.col("Bib").try_cast("double").alias("Bib"),
        "First Name",
        "Last Name",
        "Gender",
        F.col("Age").try_cast("double").alias("Age"),
    )


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotation documents (one per file) with their ``stem``, and the unreadable files."""
    schema = f"{schemas.ANNOTATION}, _corrupt_record string"
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("stem", file_stem(F.col("_metadata.file_name")))
    )
    bad = F.col("_corrupt_record").isNotNull() | F.col("shapes").isNull()
    return raw.where(~bad).drop("_corrupt_record"), raw.where(bad).select("stem")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of each file; the contents are never read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")
