"""Push documents to a search index in batches, as a Spark data source."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from paperloom.constants import FEED_BATCH, FEED_FLUSH
from paperloom.functions.articles import feed_document
from paperloom.schemas import ARTICLE

FORMAT = "paperloom_feed"
#: Where a folder of documents names the feeds that make it up.
RUNS = "_runs"

ClientFactory = Callable[[dict[str, str]], object]


@dataclass
class Fed(WriterCommitMessage):
    documents: int
    batches: int
    last_response: str | None


class FileClient:
    """A client that stores every batch as a file of JSON lines in a shared folder.

    Each feed has a folder of its own, and a file name follows from the partition and the batch,
    so a retried task replaces its own files. A batch appears under its name only when it is
    complete. When all tasks are done one small file names the folder that holds the run's
    documents: a feed that fails publishes nothing, and repeating a run replaces it, however its
    rows are partitioned then.
    """

    def __init__(self, options: dict[str, str]):
        self.files, root = _filesystem(options["path"])
        self.folder = f"{root}/{options['load']}"
        self.files.create_dir(self.folder, recursive=True)

    @staticmethod
    def publish(options: dict[str, str]) -> None:
        files, root = _filesystem(options["path"])
        files.create_dir(f"{root}/{RUNS}", recursive=True)
        _write_text(files, f"{root}/{RUNS}/{options['run']}.json", json.dumps({"load": options["load"]}))

    def feed(self, batch: list[str], partition: int, number: int) -> str:
        name = f"{partition:06d}-{number:06d}.jsonl"
        unfinished = f"{self.folder}/_{name}.{TaskContext.get().taskAttemptId()}"
        _write_text(self.files, unfinished, "".join(document + "\n" for document in batch))
        self.files.move(unfinished, f"{self.folder}/{name}")
        return json.dumps({"batch": name, "documents": len(batch)})


class FeedWriter(DataSourceArrowWriter):
    def __init__(self, client: ClientFactory, options: dict[str, str]):
        self.client = client
        self.options = options
        self.batch_size = int(options.get("batchsize", FEED_BATCH))
        self.flush_size = int(options.get("flushsize", FEED_FLUSH))

    def write(self, iterator) -> Fed:
        client = self.client(self.options)
        partition = TaskContext.get().partitionId()
        waiting: list[str] = []
        documents = batches = 0
        last = None

        def flush(rows):
            nonlocal documents, batches, last
            for start in range(0, len(rows), self.batch_size):
                batch = rows[start : start + self.batch_size]
                last = client.feed(batch, partition, batches)
                documents += len(batch)
                batches += 1

        for records in iterator:
            waiting.extend(records.column("document").to_pylist())
            while len(waiting) >= self.flush_size:
                flush(waiting[: self.flush_size])
                waiting = waiting[self.flush_size :]
        flush(waiting)
        return Fed(documents, batches, last)

    def commit(self, messages) -> None:
        """Publish the run, and leave the totals where the caller asked for them."""
        publish = getattr(self.client, "publish", None)
        if publish:
            publish(self.options)
        report = self.options.get("report")
        if report:
            fed = [m for m in messages if m is not None]
            responses = [m.last_response for m in fed if m.last_response]
            totals = {
                "documents": sum(m.documents for m in fed),
                "batches": sum(m.batches for m in fed),
                "last_response": responses[-1] if responses else None,
            }
            _write_text(*_filesystem(report), json.dumps(totals))

    def abort(self, messages) -> None:
        """Nothing was published, so there is nothing to take back."""


class FeedSource(DataSource):
    client: ClientFactory = FileClient

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "document string"

    def writer(self, schema, overwrite: bool) -> FeedWriter:
        return FeedWriter(type(self).client, dict(self.options))


def feed_documents(
    articles: DataFrame, client: ClientFactory = FileClient, run: str = "all", **options: str
) -> None:
    """Feed articles with embeddings, as the documents of ``run``: a run date, say.

    ``client`` is called with the options once per task; the result needs a
    ``feed(batch, partition, number)`` method that returns the response as text. Documents
    become JSON inside the JVM; Python only slices and sends. Feeding must be idempotent by
    id, since a task may run twice.
    """
    spark = articles.sparkSession
    # The client travels with the source, so executors need not be able to import it.
    spark.dataSource.register(type("BoundFeedSource", (FeedSource,), {"client": client}))
    documents = feed_document(articles).select(
        F.to_json(F.struct("id", "fields"), {"ignoreNullFields": "false"}).alias("document")
    )
    named = {**options, "run": run, "load": uuid.uuid4().hex}
    documents.write.format(FORMAT).mode("append").options(**named).save()


def read_fed(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored by ``FileClient``: those of every run's last feed that ended well."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in ARTICLE.fields)
    schema = f"id string, fields struct<{fields}, abstract_embedding: struct<values: array<float>>>"
    runs = spark.read.schema("load string").option("pathGlobFilter", "*.json").json(f"{path}/{RUNS}")
    loads = [f"{path}/{row.load}" for row in runs.collect()]  # one per run
    return spark.read.schema(schema).json(loads) if loads else spark.createDataFrame([], schema)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _write_text(files: fs.FileSystem, path: str, text: str) -> None:
    with files.open_output_stream(path) as out:
        out.write(text.encode("utf-8"))
