"""Writers: leaderboard, export, starter list, labels and the change feed.

Ordered files are range-sorted into numbered part files, never gathered into one
task; reading the parts in name order gives the rows in order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, ranking

# Headers of the two file formats.
LEADERBOARD = (
    "Place", "Bib", "Name", "First name", "Last name", "Age", "Gender", "Time",
    "Difference", "% Back", "% Winning", "% Average", "% Median", "team",
)
EXPORT = ("Rank", "Bib Number", "Racer Name", "Finish Time", "Gender", "Team")


def _csv(df: DataFrame):
    """Header, quotes doubled inside quoted fields, empty text left empty."""
    return (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
    )


def write_leaderboard(results: DataFrame, path: str) -> None:
    """14-column leaderboard in place order; several races go to race_id folders."""
    board = ranking.leaderboard(results).orderBy("race_id", "Place")
    _csv(board.select("race_id", *LEADERBOARD)).partitionBy("race_id").csv(path)


VERSION, COMPLETE = "version=", "_SUCCESS"


def _versions(spark: SparkSession, path: str):
    """File system, and the numbers of all versions and of the complete ones, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    numbers = sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION))
    marked = spark._jvm.org.apache.hadoop.fs.Path
    whole = [n for n in numbers if fs.exists(marked(f"{path}/{VERSION}{n}/{COMPLETE}"))]
    return fs, numbers, whole


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the latest complete version, or None before the first.

    A version is complete once Spark has committed its write, which leaves a marker file;
    one that is being written, or was given up, is passed over.
    """
    _, _, whole = _versions(spark, path)
    return f"{path}/{VERSION}{whole[-1]}" if whole else None


def write_version(
    spark: SparkSession, path: str, version: int, write: Callable[[str], None], keep: int = 3
) -> None:
    """Write a new version beside the others, then delete all but the last ``keep`` whole ones.

    ``write`` gets the version's folder and must overwrite it, as a retry writes the same
    number again.  A reader may go on with a version it has opened while ``keep`` newer
    ones are written.
    """
    if keep < 2:
        raise ValueError("keep must be 2 or more, as readers may hold the version before")
    write(f"{path}/{VERSION}{version}")
    fs, numbers, whole = _versions(spark, path)
    for old in numbers:
        if old < whole[-keep:][0]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSION}{old}"), True)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """The board last written by ``serve.versioned_board``, all columns but the race as text."""
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no complete version in {path}")
    text = ", ".join(f"`{c}` string" for c in LEADERBOARD)
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(f"{text}, race_id bigint").csv(folder)


def write_results_export(results: DataFrame, folder: str, day: date | None = None) -> str:
    """Six-column export with a dated name; name and team are always quoted."""
    day = day or date.today()
    path = f"{folder.rstrip('/')}/race_results_{day.isoformat()}.csv"
    rows = boards.export_rows(results).orderBy("race_id", "Rank")
    cells = [
        _quoted(c) if c in ("Racer Name", "Team") else _guarded(c) for c in EXPORT
    ]
    # Quoting differs by column, so a row is one finished line under a one-cell
    # header, written with a separator and a quote that no line contains.
    line = F.concat_ws(",", *cells).alias(",".join(EXPORT))
    (
        rows.select("race_id", line)
        .write.mode("overwrite")
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "\u0000")
        .partitionBy("race_id")
        .csv(path)
    )
    return path


def _quoted(c: str):
    """Always quoted; inner quotes doubled, line breaks turned into blanks."""
    flat = F.translate(F.col(c), "\r\n", "  ")
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))


def _guarded(c: str):
    """Quote other text only where the file format needs it."""
    text = F.col(c).cast("string")
    return F.when(text.rlike('[",\r\n]'), _quoted(c)).otherwise(text)


def write_starter_list(df: DataFrame, path: str) -> None:
    _csv(df).csv(path)


LABEL_FOLDERS = 256


def write_labels(texts: DataFrame, path: str, per_image: bool = False) -> None:
    """Label texts as (stem, value) rows in few files, or one text file per image.

    Files per image lie in folders named after their stems, those in ``LABEL_FOLDERS``
    folders by the stem's hash: a file system holds few entries in one folder well.
    """
    if not per_image:
        texts.select("stem", "value").write.mode("overwrite").parquet(path)
        return
    folder = F.pmod(F.xxhash64("stem"), F.lit(LABEL_FOLDERS)).alias("folder")
    texts.select(folder, "stem", "value").write.mode("overwrite").partitionBy("folder", "stem").text(path)


def write_changes(messages: DataFrame, path: str) -> None:
    """JSON messages as text lines by race; subscribers follow the folder."""
    messages.select("race_id", "value").write.mode("overwrite").partitionBy("race_id").text(path)


def write_changes_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """JSON messages to a topic, keyed by race (needs the Kafka package)."""
    keyed = messages.select(F.col("race_id").cast("string").alias("key"), "value")
    keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()
