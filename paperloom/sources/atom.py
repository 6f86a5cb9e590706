"""Landed Atom result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import ATOM

_XML_OPTIONS = {"ignoreNamespace": "true", "mode": "FAILFAST"}


def scan_atom_pages(
    spark: SparkSession, path: str, page_pattern: str = r"(\d+)\D*$"
) -> DataFrame:
    """Entries of landed pages, one file per page, numbered by the file name."""
    files = spark.read.text(path, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), page_pattern, 1).cast("long")
    return parse_atom_pages(files.select(number.alias("page"), "value"))


def parse_atom_pages(pages: DataFrame) -> DataFrame:
    """``(page, value)`` rows of whole Atom documents to one row per entry.

    Each entry keeps its place in the page. ``page_rows`` is the number of entries of the
    page, counted before it is expanded, so that the page rules need no shuffle. An empty
    page yields one row without an entry; a broken page fails the job.
    """
    feed = F.from_xml("value", ATOM.simpleString(), _XML_OPTIONS)
    counted = pages.select("page", feed["entry"].alias("entry")).withColumn(
        "page_rows", F.coalesce(F.size("entry"), F.lit(0))
    )
    expanded = counted.select(
        "page", "page_rows", F.posexplode_outer("entry").alias("pos", "one")
    )
    return expanded.select("page", "page_rows", F.col("pos").cast("long").alias("pos"), "one.*")
