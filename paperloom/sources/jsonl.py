"""Line-oriented JSON inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.constants import SAMPLE_ROWS
from paperloom.schemas import ARTICLE, RAW

CORRUPT = "_corrupt_record"


def scan_snapshot(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """The bulk snapshot. A broken line fails the job.

    With ``quarantine`` it does not; see ``split_corrupt``. Blank lines are skipped.
    """
    return _read(spark, path, RAW, quarantine)


def split_corrupt(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and broken lines with what could be read of them and their text.

    Write or use the second as it is: Spark refuses to read only the text column.
    """
    broken = F.col(CORRUPT).isNotNull()
    return scanned.where(~broken).drop(CORRUPT), scanned.where(broken)


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """Canonical articles; missing categories are empty, a missing abstract is ``""``."""
    return with_defaults(_read(spark, path, ARTICLE, quarantine=False))


def with_defaults(articles: DataFrame) -> DataFrame:
    return articles.withColumns(
        {
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
            "abstract": F.coalesce("abstract", F.lit("")),
        }
    )


def scan_dated_partition(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """One run's articles. The run date is a parameter and prunes to one folder."""
    dated = T.StructType([*ARTICLE.fields, T.StructField("ingest_date", T.DateType())])
    rows = _read(spark, path, dated, quarantine=False)
    return rows.where(F.col("ingest_date") == F.lit(run_date).cast("date"))


def scan_sample(numbered: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The development slice: the first rows in file order, by position, without a sort."""
    return numbered.where(F.col("pos") < rows)


def _read(spark, path, schema, quarantine):
    reader = spark.read
    if quarantine:
        with_text = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return (
            reader.schema(with_text)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(path)
        )
    return reader.schema(schema).option("mode", "FAILFAST").json(path)
