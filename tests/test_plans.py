"""The jobs end to end, on small files."""

from __future__ import annotations

import json

from support import rows
from test_articles import raw_record
from test_filters_and_pages import ENTRY, PAGE

from paperloom.functions.encoders import hash_encoder
from paperloom.plans import bulk, daily
from paperloom.schemas import RAW
from paperloom.sinks.articles import stored_collection
from paperloom.sinks.feed import FileClient, read_fed
from paperloom.sources.jsonl import scan_articles, scan_dated_partition
from paperloom.sources.vectors import scan_embeddings
from paperloom.streaming.cursor import cursor_history, write_cursor


def test_bulk_run(spark, tmp_path):
    """Two categories differ in case only: both are embedded and fed."""
    snapshot, articles, vectors, fed = (str(tmp_path / n) for n in ("in", "articles", "vectors", "fed"))
    records = [
        raw_record(id=f"2401.{n:05d}", categories=c, abstract=f"text {n}")
        for n, c in enumerate(["cs.AI", "CS.AI", "math", "cs.LG x"])
    ]
    spark.createDataFrame(records, RAW).coalesce(1).write.json(snapshot)
    cursor = str(tmp_path / "cursor")
    bulk.normalise_snapshot(spark, snapshot, articles, cursor, "2024-06-30T00:00:00")
    assert cursor_history(spark, cursor).first().last_updated.isoformat().startswith("2024-06-27")
    assert scan_articles(spark, articles).count() == 4
    bulk.embed_articles(spark, articles, vectors, hash_encoder())
    assert rows(scan_embeddings(spark, vectors).select("id", "pos")) == [
        ("2401.00000v2", 0),
        ("2401.00001v2", 1),
        ("2401.00003v2", 2),
    ]
    counted = bulk.feed_articles(spark, articles, vectors, FileClient, path=fed)
    assert tuple(counted) == (4, 3, 1)
    collection = str(tmp_path / "collection")
    bulk.collect_articles(spark, articles, collection)
    assert stored_collection(spark, collection).count() == 3
    found = {r.id: r.fields.abstract_embedding["values"] for r in read_fed(spark, fed).collect()}
    encoded = hash_encoder()()(["text 0", "text 1", "text 3"])
    ids = ["2401.00000v2", "2401.00001v2", "2401.00003v2"]
    assert found == {i: e.tolist() for i, e in zip(ids, encoded, strict=True)}
    document = json.loads(next((tmp_path / "fed").glob("*/0*.jsonl")).read_text().splitlines()[0])
    assert "authors_parsed" not in document["fields"]


def test_resumed_feed(spark, tmp_path):
    snapshot, articles, vectors, fed = (str(tmp_path / n) for n in ("in", "articles", "vectors", "fed"))
    records = [raw_record(id=f"2401.{n:05d}", abstract=f"text {n}") for n in range(6)]
    spark.createDataFrame(records, RAW).coalesce(1).write.json(snapshot)
    bulk.normalise_snapshot(spark, snapshot, articles)
    bulk.embed_articles(spark, articles, vectors, hash_encoder(), batch_size=4)
    counted = bulk.feed_articles(
        spark, articles, vectors, FileClient, restart_from=2, cap=3, path=fed
    )
    assert tuple(counted) == (2, 2, 0)
    encoded = hash_encoder()()(["text 2", "text 3"])
    assert {r.id: r.fields.abstract_embedding["values"] for r in read_fed(spark, fed).collect()} == {
        "2401.00002v2": encoded[0].tolist(),
        "2401.00003v2": encoded[1].tolist(),
    }


def test_daily_run_is_repeatable(spark, tmp_path):
    pages, out, cursor = (str(tmp_path / n) for n in ("pages", "out", "cursor"))
    (tmp_path / "pages").mkdir()
    for page in range(3):
        numbers = (8 - 2 * page, 7 - 2 * page)
        text = PAGE.format(entries="".join(ENTRY.format(n=n) for n in numbers))
        (tmp_path / "pages" / f"page-{page}.xml").write_text(text)
    write_cursor(spark, cursor, "2024-06-30T03:00:07")
    fetched = [daily.run_daily(spark, pages, out, cursor, "2024-07-01", page_size=2) for _ in range(2)]
    assert [(r.short_pages, r.moved) for r in fetched] == [((), True)] * 2
    # First pages 0 and 1, as the second one reaches past the cursor. The cursor then stands
    # within three hours of all pages, so the repeated run reads them all, and replaces.
    assert [r.fetched for r in fetched] == [4, 6]
    stored = scan_dated_partition(spark, out, "2024-07-01")
    assert stored.count() == 6 and stored.select("id").distinct().count() == 6
    last = cursor_history(spark, cursor).orderBy("seq").collect()
    assert [str(r.last_updated) for r in last] == [
        "2024-06-30 03:00:07",
        "2024-06-30 00:00:08",
        "2024-06-30 00:00:08",
    ]
    daily.run_daily(spark, pages, out, cursor, "2024-07-02", page_size=2)
    assert scan_dated_partition(spark, out, "2024-07-01").count() > 0
    # the steps behind it, by run date: repeating one run leaves the others as they are
    vectors, fed, collection = (str(tmp_path / n) for n in ("vectors", "fed", "collection"))
    for run_date in ("2024-07-01", "2024-07-02", "2024-07-01"):
        wanted = scan_dated_partition(spark, out, run_date)
        daily.embed_day(spark, out, vectors, run_date, hash_encoder())
        counted = daily.feed_day(spark, out, vectors, run_date, FileClient, path=fed)
        assert counted.processed == counted.ingested == wanted.count() > 0
        daily.collect_day(spark, out, collection, run_date)
    runs = [sorted(r.id for r in scan_dated_partition(spark, out, d).collect()) for d in ("2024-07-01", "2024-07-02")]
    assert sorted(r.id for r in read_fed(spark, fed).collect()) == sorted(runs[0] + runs[1])
    stored = stored_collection(spark, collection)
    assert sorted(r.id for r in stored.collect()) == sorted({*runs[0], *runs[1]})
    assert stored.agg({"load_seq": "max"}).first()[0] == 2


def test_daily_run_loses_no_page(spark, tmp_path):
    """A short last page counts; a short inner page, or a budget that cuts, keeps the cursor."""
    def run(name, sizes, **options):
        pages, out, cursor = (str(tmp_path / name / n) for n in ("pages", "out", "cursor"))
        (tmp_path / name / "pages").mkdir(parents=True)
        number = sum(sizes)
        for page, size in enumerate(sizes):
            text = "".join(ENTRY.format(n=number - k) for k in range(size))
            number -= size
            (tmp_path / name / "pages" / f"page-{page}.xml").write_text(PAGE.format(entries=text))
        write_cursor(spark, cursor, "2024-06-29T00:00:00")
        report = daily.run_daily(spark, pages, out, cursor, "2024-07-01", page_size=2, **options)
        return report, scan_dated_partition(spark, out, "2024-07-01").count(), cursor_history(spark, cursor).count()

    assert run("last", [2, 2, 1]) == (daily.DailyReport(5, (), True), 5, 2)
    assert run("inner", [2, 1, 2]) == (daily.DailyReport(5, (1,), False), 5, 1)
    assert run("budget", [2, 2, 2], last_page=1) == (daily.DailyReport(4, (), False), 4, 1)
