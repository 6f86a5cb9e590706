from __future__ import annotations

import gzip
import json
import subprocess
import sys
from pathlib import Path

import pytest
from support import plan_of, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.functions.encoders import hash_encoder
from paperloom.operators import attach, joins, positions
from paperloom.operators.collection import latest_by_id, union_origins
from paperloom.operators.nearest import _best_pairs
from paperloom.schemas import ARTICLE
from paperloom.sinks import articles as sink
from paperloom.sinks import feed
from paperloom.sources import jsonl, vectors


def article(spark, *ids, origin="kaggle", title="t", ts=0):
    blank = dict.fromkeys(ARTICLE.names)
    data = [
        tuple(
            {**blank, "id": i, "title": title, "origin": origin, "update_date_ts": ts}[n]
            for n in ARTICLE.names
        )
        for i in ids
    ]
    return spark.createDataFrame(data, ARTICLE)


def test_snapshot_lines(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"id": "1", "journal-ref": "J", "unknown": 1}\n\n{"id": "2"}\n')
    scanned = jsonl.scan_snapshot(spark, str(good))
    assert rows(scanned.select("id", "journal-ref")) == [("1", "J"), ("2", None)]
    broken = tmp_path / "broken.json"
    broken.write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        jsonl.scan_snapshot(spark, str(broken)).collect()
    lenient = jsonl.scan_snapshot(spark, str(broken), quarantine=True)
    kept, bad = jsonl.split_corrupt(lenient)
    assert rows(kept.select("id")) == [("1",)]
    assert [r[jsonl.CORRUPT] for r in bad.collect()] == ['{"id": ']


def test_article_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1"}\n{"id": "2", "categories": null, "abstract": "x"}\n')
    found = jsonl.scan_articles(spark, str(tmp_path)).select("id", "categories", "abstract")
    assert rows(found) == [("1", [], ""), ("2", [], "x")]


def test_jsonl_keeps_null_fields(spark, tmp_path):
    sink.write_jsonl(article(spark, "1"), str(tmp_path / "out"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert set(json.loads(line)) == set(ARTICLE.names)
    assert json.loads(line)["submitter"] is None


def test_dated_overwrite_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "dated")
    sink.write_dated_overwrite(article(spark, "1", "2"), path, "2024-06-29")
    for _ in range(2):
        sink.write_dated_overwrite(article(spark, "3"), path, "2024-06-30")
    assert rows(jsonl.scan_dated_partition(spark, path, "2024-06-29").select("id")) == [("1",), ("2",)]
    one = jsonl.scan_dated_partition(spark, path, "2024-06-30")
    assert rows(one.select("id")) == [("3",)]
    assert "PartitionFilters: [isnotnull(ingest_date" in plan_of(one)


def test_embedding_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "vectors")
    data = spark.range(100).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("embedding")
    )
    sink.write_embeddings(data, path, rows_per_file=30)
    part = vectors.scan_embeddings_range(vectors.scan_embeddings(spark, path), 10, 20)
    assert sorted(r.pos for r in part.collect()) == list(range(10, 20))
    assert "GreaterThanOrEqual(pos,10)" in plan_of(part) and "LessThan(pos,20)" in plan_of(part)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", opening)


def uneven_files(folder):
    """Files of uneven size, one of them compressed; returns all ids in file order."""
    order, n = [], 0
    for i, size in enumerate((5, 700, 1, 0, 350, 40, 901)):
        ids = [f"a{n + k}" for k in range(size)]
        n += size
        text = "".join(json.dumps({"id": x, "categories": ["cs.AI" if len(x) % 2 else "q"]}) + "\n" for x in ids)
        if i == 4:
            (folder / f"f{i}.json.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (folder / f"f{i}.json").write_text(text)
        order += ids
    return order


def test_positions_follow_the_files(spark, tmp_path, small_splits):
    order = uneven_files(tmp_path)
    scan = spark.read.schema("id string, categories array<string>").json(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 10
    numbered = positions.row_positions(positions.stage_in_file_order(scan))
    assert [r.id for r in numbered.orderBy("pos").collect()] == order
    assert sorted(r.pos for r in numbered.collect()) == list(range(len(order)))
    kept = scan.where("array_contains(categories, 'cs.AI')")
    renumbered = positions.row_positions(positions.stage_in_file_order(kept))
    wanted = [x for x in order if len(x) % 2]
    assert [r.id for r in renumbered.orderBy("pos").collect()] == wanted


def test_offsets_are_broadcast_or_salted(spark, tmp_path, small_splits, monkeypatch):
    order = uneven_files(tmp_path)
    scan = spark.read.schema("id string, categories array<string>").json(str(tmp_path))
    staged = positions.stage_in_file_order(scan)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = positions.row_positions(staged)
        assert "BroadcastHashJoin" in plan_of(few) and "hashpartitioning(_src_file" not in plan_of(few)
        assert [r.id for r in few.orderBy("pos").collect()] == order
        monkeypatch.setattr(joins.lookup_join, "__defaults__", (0,))
        many = positions.row_positions(staged)
        assert "_salt" in plan_of(many)
        assert [r.id for r in many.orderBy("pos").collect()] == order
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positional_and_keyed_attach_agree(spark, tmp_path, small_splits):
    order = uneven_files(tmp_path)
    scan = spark.read.schema("id string, categories array<string>").json(str(tmp_path))
    numbered = positions.row_positions(positions.stage_in_file_order(scan))
    matrix = spark.createDataFrame([(x, [float(i)]) for i, x in enumerate(order)], "id string, embedding array<float>")
    path = str(tmp_path / "matrix")
    matrix.coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    keyless = positions.parquet_positions(spark.read.parquet(path).select("embedding"))
    by_place = attach.attach_embeddings_positional(numbered, keyless).select("id", "embedding")
    assert rows(by_place) == rows(attach.attach_embeddings(numbered, matrix).select("id", "embedding"))
    resumed = attach.attach_embeddings_positional(numbered.where("pos >= 5"), keyless)
    assert {r.id: r.embedding[0] for r in resumed.collect()} == {
        x: float(i) for i, x in enumerate(order) if i >= 5
    }
    short = keyless.where("pos < 100")
    with pytest.raises(Exception, match="no vector at position"):
        attach.attach_embeddings_positional(numbered, short).collect()
    assert attach.attach_embeddings_positional(numbered, short, check=False).count() == 100


def test_batch_ranges(spark):
    numbered = spark.range(10).select(F.col("id").alias("pos"))
    assert rows(positions.batch_ranges(numbered, 4)) == [(0, 0, 4, 4), (1, 4, 8, 4), (2, 8, 10, 2)]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "collection")
    sink.upsert_articles(spark, path, article(spark, "2401.1v1", "2402.1v1", "hep-ph/1v1"), 1)
    untouched = sorted(p.name for p in (tmp_path / "collection" / "part=2402").iterdir())
    for _ in range(2):
        newer = article(spark, "2401.1v1", "2401.2v1", origin="arxiv_api", title="new")
        sink.upsert_articles(spark, path, newer, 2)
    stored = sink.stored_collection(spark, path)
    assert rows(stored.select("id", "title", "load_seq", "part")) == [
        ("2401.1v1", "new", 2, "2401"),
        ("2401.2v1", "new", 2, "2401"),
        ("2402.1v1", "t", 1, "2402"),
        ("hep-ph/1v1", "t", 1, spark.range(1).select(sink.storage_part(F.lit("hep-ph/1v1"))).first()[0]),
    ]
    many = spark.range(5000).select(sink.storage_part(F.format_string("hep-ph/%07dv1", "id")).alias("part"))
    assert many.distinct().count() == sink.OTHER_PARTS
    assert sorted(p.name for p in (tmp_path / "collection" / "part=2402").iterdir()) == untouched


def test_upsert_shuffles_whole_rows_once(spark, tmp_path, monkeypatch):
    loads = article(spark, "2401.1v1", "2401.1v1", "2401.2v1").withColumns(
        {"load_seq": F.lit(1).cast("long"), "part": F.lit("2401")}
    )
    monkeypatch.setattr(sink, "ROWS_PER_PLACE", 1)
    merged = latest_by_id(sink._placed(loads, {"2401": 2}), [sink.PLACE])
    assert plan_of(merged).count("Exchange hashpartitioning") == 1
    assert sorted(r.id for r in merged.collect()) == ["2401.1v1", "2401.2v1"]
    with pytest.raises(Exception, match="articles changed"):
        sink._placed(loads, {"2402": 1}).collect()
    # one load holds very many copies of an id; nothing but the collection is written
    monkeypatch.setattr(sink, "MAX_COPIES", 5)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = list(shared.iterdir())
    path = str(tmp_path / "collection")
    for title in ("old", "new"):
        sink.upsert_articles(spark, path, article(spark, *["2401.1v1"] * 20, "2403.1v1", title=title))
    stored = sink.stored_collection(spark, path)
    assert rows(stored.select("id", "title", "load_seq")) == [("2401.1v1", "new", 1), ("2403.1v1", "new", 1)]
    assert list(shared.iterdir()) == before


def test_latest_row_drops_copies_before_the_shuffle(spark):
    loads = union_origins(
        article(spark, *["x"] * 500, "y").withColumn("load_seq", F.lit(1)),
        article(spark, "x", origin="arxiv_api").withColumn("load_seq", F.lit(2)),
    )
    latest = latest_by_id(loads)
    assert rows(latest.select("id", "load_seq")) == [("x", 2), ("y", 1)]
    plan = plan_of(latest)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    same_load = union_origins(article(spark, "x", ts=1), article(spark, "x", ts=2)).withColumn("load_seq", F.lit(1))
    assert latest_by_id(same_load).first().update_date_ts == 2


def test_feed_batches(spark, tmp_path):
    ids = [f"i{n:05d}" for n in range(1001)]
    fed = article(spark, *ids).withColumn("embedding", F.array(F.lit(0.5).cast("float"))).coalesce(1)
    report = str(tmp_path / "report.json")
    for _ in range(2):  # feeding again replaces the same documents
        feed.feed_documents(fed, path=str(tmp_path / "feed"), report=report)
    totals = json.loads((tmp_path / "report.json").read_text())
    assert (totals["documents"], totals["batches"]) == (1001, 3)
    assert json.loads(totals["last_response"])["documents"] == 1
    found = feed.read_fed(spark, str(tmp_path / "feed"))
    assert sorted(r.id for r in found.collect()) == ids
    document = json.loads(next((tmp_path / "feed").glob("*/0*.jsonl")).read_text().splitlines()[0])
    assert set(document) == {"id", "fields"}
    assert set(document["fields"]) == {*ARTICLE.names, "abstract_embedding"}
    assert document["fields"]["abstract_embedding"] == {"values": [0.5]}


def test_feed_of_a_run_is_replaced_whole_or_not_at_all(spark, tmp_path):
    def documents(*ids):
        return article(spark, *ids).withColumn("embedding", F.array(F.lit(0.5).cast("float")))

    def stored():
        return sorted(r.id for r in feed.read_fed(spark, path).collect())

    path = str(tmp_path / "feed")
    feed.feed_documents(documents(*map(str, range(40))).repartition(7), path=path, run="1")
    feed.feed_documents(documents("a", "b").coalesce(1), path=path, run="2")
    feed.feed_documents(documents(*map(str, range(30))).repartition(3), path=path, run="1")
    assert stored() == sorted(["a", "b", *map(str, range(30))])
    broken = documents("c", "d").withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        feed.feed_documents(broken, path=path, run="2")
    assert stored() == sorted(["a", "b", *map(str, range(30))])


def test_articles_without_vector_are_told(spark):
    kept = article(spark, "x", "y")
    vectors = spark.createDataFrame([("x", [0.5])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="no vector for article y"):
        attach.attach_embeddings(kept, vectors).collect()
    assert rows(attach.attach_embeddings(kept, vectors, check=False).select("id")) == [("x",)]
    assert rows(attach.articles_without_vector(kept, vectors).select("id")) == [("y",)]


def test_any_client_can_be_handed_in(spark, tmp_path):
    class Client:
        def __init__(self, options):
            self.target = options["target"]

        def feed(self, batch, partition, number):
            return f"{self.target}: {len(batch)} documents, the first {json.loads(batch[0])['id']}"

    fed = article(spark, "x", "y").withColumn("embedding", F.array(F.lit(0.5))).coalesce(1)
    feed.feed_documents(fed, Client, target="there", report=str(tmp_path / "r"))
    assert json.loads((tmp_path / "r").read_text())["last_response"] == "there: 2 documents, the first x"


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What is sent to Python workers loads where the package cannot be imported."""
    shipped = tmp_path / "shipped"
    shipped.write_bytes(cloudpickle.dumps((hash_encoder(), feed.FeedSource, _best_pairs)))
    script = (
        "import pickle, sys; encoder, source, _ = pickle.load(open(sys.argv[1], 'rb'));"
        "print(encoder()(['a b']).shape, source.name(), 'paperloom' in sys.modules)"
    )
    run = [sys.executable, "-I", "-c", script, str(shipped)]
    done = subprocess.run(run, cwd="/", capture_output=True, text=True, timeout=120)
    assert done.stdout.split("\n")[0] == "(1, 384) paperloom_feed False", done.stderr


def test_feed_flush_keeps_batches_whole(spark, tmp_path):
    fed = article(spark, *map(str, range(25))).withColumn("embedding", F.array(F.lit(0.5))).coalesce(1)
    feed.feed_documents(fed, path=str(tmp_path / "f"), report=str(tmp_path / "r"), batchSize="4", flushSize="10")
    assert json.loads((tmp_path / "r").read_text())["batches"] == 8  # 4+4+2, 4+4+2, 4+1
