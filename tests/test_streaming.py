from __future__ import annotations

from support import rows
from pyspark.sql import functions as F
from test_io import article

from paperloom.sinks.articles import stored_collection, upsert_articles, write_jsonl
from paperloom.streaming import cursor
from paperloom.streaming.ingest import stream_dedup_overlap, stream_ingest


def land(spark, folder, ids, ts, title="t"):
    batch = article(spark, *ids, ts=ts, title=title).withColumn("categories", F.array(F.lit("CS.ai")))
    write_jsonl(batch.coalesce(1), folder, mode="append")


def test_ingest_equals_batch_and_reads_each_file_once(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    land(spark, landing, ["2401.1v1", "2401.2v1"], 1)
    for _ in range(2):
        stream_ingest(spark, landing, table, state).awaitTermination()
    assert stored_collection(spark, table).count() == 2
    land(spark, landing, ["2401.2v1", "2402.1v1"], 0, title="later load, older date")
    query = stream_ingest(spark, landing, table, state)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert rows(stored_collection(spark, table).select("id", "title")) == [
        ("2401.1v1", "t"),
        ("2401.2v1", "later load, older date"),
        ("2402.1v1", "later load, older date"),
    ]


def test_unwanted_categories_are_left_out(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    land(spark, landing, ["2401.1v1"], 1)
    write_jsonl(article(spark, "2401.9v1"), landing, mode="append")
    stream_ingest(spark, landing, table, state).awaitTermination()
    assert rows(stored_collection(spark, table).select("id")) == [("2401.1v1",)]


def test_dedup_drops_repeats_and_keeps_late_rows(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    hour = 3600
    for ids, ts in (["a"], 100 * hour), (["a", "b"], 100 * hour), (["late"], 90 * hour), (["c"], 99 * hour):
        land(spark, landing, ids, ts)
        stream_dedup_overlap(spark, landing, out, state).awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [("a",), ("b",), ("c",), ("late",)]
    table = str(tmp_path / "table")
    stream_ingest(spark, landing, table, str(tmp_path / "other")).awaitTermination()
    assert rows(stored_collection(spark, table).select("id")) == [("a",), ("b",), ("c",), ("late",)]


def test_cursor(spark, tmp_path):
    path = str(tmp_path / "cursor")

    def latest():
        value = spark.range(1).select(cursor.read_cursor(spark, path).cast("string")).first()[0]
        return value

    cursor.seed_cursor(spark, path, "2024-06-30T12:00:00")
    assert latest() == "2024-06-27 12:00:00"
    stored = article(spark, "a", ts=1719748800)
    cursor.advance_cursor(spark, path, stored)
    assert latest() == "2024-06-30 12:00:00"
    cursor.advance_cursor(spark, path, stored.where("false"))
    assert latest() == "2024-06-30 12:00:00"
    assert [r.seq for r in cursor.cursor_history(spark, path).orderBy("seq").collect()] == [0, 1]


def test_stream_replaces_what_a_bulk_load_brought(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    ids = [f"2401.{n:05d}v1" for n in range(20)]
    upsert_articles(spark, table, article(spark, *ids, ts=5, title="bulk"))
    upsert_articles(spark, table, article(spark, *ids, ts=5, title="bulk again"))
    for part in (ids[:7], ids[7:]):
        land(spark, landing, part, 1, "stream")
    stream_ingest(spark, landing, table, state, max_files=1).awaitTermination()
    stored = stored_collection(spark, table)
    assert rows(stored.select("id", "title")) == [(i, "stream") for i in ids]
    assert stored.agg(F.min("load_seq")).first()[0] == 2


def test_dedup_does_not_depend_on_batches(spark, tmp_path):
    landing = str(tmp_path / "landing")
    for n, ts in enumerate((100_000, 1, 50_000, 100_000)):
        land(spark, landing, [f"a{n}", f"b{n}", "same"], ts if n < 3 else 50_000, f"t{n}")
    found = []
    for max_files in (None, 1):
        out, state = str(tmp_path / f"out{max_files}"), str(tmp_path / f"state{max_files}")
        stream_dedup_overlap(spark, landing, out, state, max_files=max_files).awaitTermination()
        found.append(rows(spark.read.parquet(out).select("id", "update_date_ts")))
    assert found[0] == found[1] and len(found[0]) == 11
