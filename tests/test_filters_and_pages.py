from __future__ import annotations

import pytest
from support import plan_of, rows
from pyspark.sql import functions as F

from paperloom.operators import collection, filters, paging
from paperloom.plans.daily import select_pages
from paperloom.sources.atom import parse_atom_pages, scan_atom_pages


def test_category_filters(spark):
    data = [(1, ["cs.AI"]), (2, ["CS.AI"]), (3, []), (4, None), (5, ["x", None]), (6, ["x", "cs.LG"])]
    df = spark.createDataFrame(data, "id int, categories array<string>")
    assert [r.id for r in filters.filter_categories(df).collect()] == [1, 6]
    assert [r.id for r in filters.filter_categories_ci(df).collect()] == [1, 2, 6]
    keep = filters.in_categories(F.col("categories"))
    assert df.where(keep.isNull()).count() == 0
    assert tuple(collection.feed_counters(df, keep).first()) == (6, 2, 4)
    folded = spark.range(1).select(filters.fold_subset(["cs.AI", "CS.ai", "b"])).first()[0]
    assert folded == ["cs.ai", "b"]


def test_restart_and_cap(spark):
    numbered = spark.range(10).select(F.col("id").alias("pos"))
    assert filters.filter_cap(numbered, 3).count() == 4
    assert filters.filter_cap(numbered).count() == 10
    assert filters.filter_restart(numbered).count() == 10
    assert filters.filter_restart(numbered, 5).count() == 5


def entries(spark, newest, per_page=3):
    """Pages whose first kept entry has the given date; None keeps nothing."""
    data = []
    for page, value in enumerate(newest):
        for pos in range(per_page):
            data.append((page, pos, 1000 if value is None else value - pos, value is not None))
    return spark.createDataFrame(data, "page long, pos long, updated int, keep boolean")


@pytest.mark.parametrize("cursor,pages", [(95, {0, 1, 2}), (101, {0}), (0, {0, 1, 2, 3})])
def test_page_cutoff(spark, cursor, pages):
    df = entries(spark, [100, None, 90, 88])
    cut = paging.filter_page_cutoff(df, F.lit(cursor), F.col("updated"), F.col("keep"))
    assert {r.page for r in cut.collect()} == pages
    assert cut.count() == 3 * len(pages)  # whole pages, also rows older than the cursor


def test_full_pages_and_counter(spark):
    df = entries(spark, [5, 4]).where("not (page = 1 and pos = 2)")
    full = paging.filter_full_pages(df, 3)
    assert {r.page for r in full.collect()} == {0}
    assert rows(paging.short_pages(df, 3)) == [(1, 2)]
    counted = df.withColumn("page_rows", F.when(F.col("page") == 0, 3).otherwise(2))
    assert {r.page for r in paging.filter_full_pages(counted, 3).collect()} == {0}
    assert "Exchange" not in plan_of(paging.filter_full_pages(counted, 3))
    assert paging.fetch_counter(full, 3).first()[0] == 3


def test_page_budget(spark):
    df = spark.range(102).select(F.col("id").alias("page"))
    assert paging.filter_page_limit(df).count() == 101


def test_page_by_update(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("u"))
    page = paging.page_by_update(df, F.col("u"), 1, 3)
    assert [r.id for r in page.collect()] == ["1", "4", "7"]
    assert paging.page_by_update(df, F.col("u"), 101, 3).count() == 0
    seen, last = [], None
    while page := paging.page_after(df, F.col("u"), last, 4).collect():
        seen += [r.id for r in page]
        last = (page[-1].u, page[-1].id)
    assert seen == ["2", "5", "8", "1", "4", "7", "0", "3", "6", "9"]


PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <title>result</title>{entries}</feed>"""
ENTRY = """
  <entry><id>http://arxiv.org/abs/2301.0000{n}v1</id><updated>2024-06-30T00:00:0{n}Z</updated>
    <published>2023-01-01T00:00:00Z</published><title>T &amp; {n}</title><summary> s {n}
    </summary><author><name>A</name></author><author><name>B</name></author>
    <arxiv:comment>c {n}</arxiv:comment><category term="cs.AI" scheme="x"/>
    <category term="cs.LG" scheme="x"/></entry>"""


def test_atom_pages(spark, tmp_path):
    (tmp_path / "page-0.xml").write_text(PAGE.format(entries=ENTRY.format(n=1) + ENTRY.format(n=2)))
    (tmp_path / "page-12.xml").write_text(PAGE.format(entries=ENTRY.format(n=3)))
    (tmp_path / "page-13.xml").write_text(PAGE.format(entries=""))
    df = scan_atom_pages(spark, str(tmp_path))
    found = {(r.page, r.pos): r for r in df.collect()}
    assert set(found) == {(0, 0), (0, 1), (12, 0), (13, None)}
    assert found[0, 1].title == "T & 2" and found[0, 1].summary == "s 2"
    assert [a.name for a in found[12, 0].author] == ["A", "B"]
    assert [c._term for c in found[12, 0].category] == ["cs.AI", "cs.LG"]
    assert found[12, 0].comment == "c 3"
    assert {k: r.page_rows for k, r in found.items()}[(13, None)] == 0
    assert found[0, 0].page_rows == 2
    (tmp_path / "page-14.xml").write_text("<feed><entry><id>cut off")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        df = scan_atom_pages(spark, str(tmp_path)).collect()


def test_daily_selection(spark):
    """Short and unwanted pages, a page budget, the cursor margin, and the category filter together."""
    pages = [
        (page, PAGE.format(entries="".join(ENTRY.format(n=n) for n in range(count))))
        for page, count in ((0, 2), (1, 1), (2, 2))
    ]
    df = parse_atom_pages(spark.createDataFrame(pages, "page long, value string"))
    cursor = F.lit("2024-06-30T02:00:00").cast("timestamp")
    kept = select_pages(df, cursor)
    assert {(r.page, r.pos) for r in kept.collect()} == {(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)}
    late = F.lit("2024-06-30T04:00:00").cast("timestamp")
    assert {r.page for r in select_pages(df, late).collect()} == {0}
    assert select_pages(df, cursor, subset=["cs.DB"]).count() == 0
    assert {r.page for r in select_pages(df, cursor, last_page=1).collect()} == {0, 1}
