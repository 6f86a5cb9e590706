"""Writers for articles and vectors."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.constants import VECTOR_CHUNK_ROWS
from paperloom.operators.collection import latest_by_id
from paperloom.schemas import ARTICLE

#: The stored collection: articles, the load each came from, and the storage partition.
STORED = T.StructType(
    [
        *ARTICLE.fields,
        T.StructField("load_seq", T.LongType()),
        T.StructField("part", T.StringType()),
    ]
)


#: Folders of the ids that have no month.
OTHER_PARTS = 256

#: Rows that are merged and written together, about 40 MB of them.
ROWS_PER_PLACE = 20_000
PLACE = "_place"

#: Copies of one id in one load that still go through the shuffle.
MAX_COPIES = 1_000


def write_jsonl(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, with a key for every field, null or not."""
    articles.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_dated_overwrite(articles: DataFrame, path: str, run_date: str) -> None:
    """Replace one run's folder; the folders of other dates stay."""
    (
        articles.withColumn("ingest_date", F.lit(run_date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("ingest_date")
        .json(path)
    )


def write_embeddings(
    embeddings: DataFrame,
    path: str,
    mode: str = "errorifexists",
    rows_per_file: int = VECTOR_CHUNK_ROWS * 1_000,
) -> None:
    """``(id, pos, embedding)`` ordered by position inside each file.

    The order gives every row group a narrow position range, so that reads of a range skip
    the rest. Sorting is per task; nothing is shuffled.
    """
    (
        embeddings.select("id", "pos", F.col("embedding").cast("array<float>"))
        .sortWithinPartitions("pos")
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def storage_part(article_id: Column) -> Column:
    """The month prefix of a new-style id (``2401``), or ``other-`` and a hash of any other id.

    An id keeps its folder for ever, so an update finds the old row there. Ids without a month
    are many, so they are split, and a load rewrites only the parts that it touches.
    """
    month = F.regexp_extract(article_id, r"^(\d{4})\.\d", 1)
    return F.when(month != "", month).otherwise(
        F.concat(F.lit("other-"), F.pmod(F.xxhash64(article_id), F.lit(OTHER_PARTS)).cast("string"))
    )


def upsert_articles(
    spark: SparkSession, path: str, incoming: DataFrame, load_seq: int | None = None
) -> None:
    """Merge ``incoming`` into the stored collection by id; the latest load wins.

    Without ``load_seq`` this load is later than all that are stored.
    Only the folders that ``incoming`` touches are read and rewritten. Their names are
    four-digit months and numbered parts, at most 10,256, so they are fetched and prune the scan.
    Repeating a load leaves the collection as it was. New files replace a folder only
    after all tasks are done; a lost executor costs a retry, not data.

    The ids are looked through first, the rows then: whole rows are shuffled once, to the places
    they are written from, which hold all copies of an id. An id with very many copies in
    ``incoming`` is reduced to one before that. If ``incoming`` is another table the second
    time, with rows of a folder that the first time did not name, the load fails.
    """
    load_seq = next_load(spark, path) if load_seq is None else load_seq
    new = incoming.select(
        *ARTICLE.names,
        F.lit(load_seq).cast("long").alias("load_seq"),
        storage_part(F.col("id")).alias("part"),
    )
    stored = stored_collection(spark, path)
    copies = new.groupBy("part", "id").agg(F.count("*").alias("copies"))
    sizes = copies.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.max("copies").alias("copies")
    ).collect()
    n_rows = {row.part: row.n_rows for row in sizes}
    if any(row.copies > MAX_COPIES for row in sizes):
        new = latest_by_id(new)
    if stored is not None:
        touched = stored.where(F.col("part").isin(list(n_rows)))
        for row in touched.groupBy("part").agg(F.count("*").alias("n_rows")).collect():
            n_rows[row.part] += row.n_rows
        new = touched.unionByName(new)
    (
        latest_by_id(_placed(new, n_rows), [PLACE])
        .drop(PLACE)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("part")
        .parquet(path)
    )


def _placed(rows: DataFrame, n_rows: dict[str, int]) -> DataFrame:
    """Rows brought together by folder, and by a hash of the id where a folder is large."""
    spark = rows.sparkSession
    places = [math.ceil(n / ROWS_PER_PLACE) for n in n_rows.values()]
    known = spark.createDataFrame(
        pa.table({"part": pa.array(n_rows, pa.string()), "_places": pa.array(places, pa.int32())})
    )
    place = F.concat_ws(
        "/", "part", F.pmod(F.xxhash64("id"), F.coalesce("_places", _unknown(F.col("part"))))
    )
    placed = rows.join(F.broadcast(known), "part", "left").withColumn(PLACE, place)
    return placed.select(*STORED.names, PLACE).repartition(PLACE)


def _unknown(part: Column) -> Column:
    message = F.concat(F.lit("the incoming articles changed: no id was in folder "), part)
    return F.raise_error(message).cast("int")


def next_load(spark: SparkSession, path: str) -> int:
    """The number of the next load into the stored collection, whichever ingest brings it."""
    stored = stored_collection(spark, path)
    last = None if stored is None else stored.agg(F.max("load_seq")).first()[0]
    return 0 if last is None else last + 1


def stored_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored collection, or None before the first load."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
