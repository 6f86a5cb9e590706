"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def build_session(app_name: str = "paperloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here fixes a degree of parallelism: the cluster's own partition and memory
    settings, and adaptive execution, decide that.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session says otherwise.

    Spark fills a batch with 10,000 rows or 64 MB, which the executor and the Python worker of every
    core hold beside what they make of it. Rows and results are the same.
    """
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Written tables are used to cut lineage, so they must outlive the executor that wrote
    them. Without that setting the folder given to ``setCheckpointDir`` is used, and else one
    beside the warehouse tables, which the cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext.getCheckpointDir()
        root = given or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from it.

    For results that are small, costly and used more than once: they are computed a single
    time, and losing an executor later does not bring the cost back.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
