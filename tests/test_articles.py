from __future__ import annotations

import pytest
from support import rows
from pyspark.sql import functions as F

from paperloom.constants import PASSAGE_PREFIX_MODEL
from paperloom.functions import articles as art
from paperloom.functions import text as txt
from paperloom.schemas import ARTICLE, ENTRY, RAW, VERSION


def raw_record(**changes):
    record = {
        "id": "0001.0001",
        "submitter": None,
        "authors": "J. Doe, A. B. Roe Jr",
        "title": "A title\n  in two lines",
        "comments": "3 pages",
        "journal-ref": "J 1",
        "doi": None,
        "report-no": "R 1",
        "categories": "cs.AI cs.LG",
        "license": None,
        "abstract": "  Text.\n",
        "versions": [("v1", "Tue, 3 Mar 2015 10:20:30 GMT"), ("v2", None)],
        "update_date": "2016-05-04",
        "authors_parsed": [["Doe", "J.", ""], ["Roe", "A. B.", "Jr", "dropped"]],
    }
    return tuple({**record, **changes}[name] for name in RAW.names)


def one(spark, column, schema, value):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def test_bulk_record(spark):
    normalised = art.bulk_to_article(spark.createDataFrame([raw_record()], RAW))
    article = normalised.first()
    assert article.id == "0001.0001v2"
    assert article.link == "http://arxiv.org/abs/0001.0001v2"
    assert article.authors == ["J. Doe", "A. B. Roe Jr"]
    assert article.categories == ["cs.AI", "cs.LG"]
    assert article.update_date == "2016-05-04T00:00:00"
    assert article.update_date_ts == 1462320000
    assert (article.journal_ref, article.report_no, article.origin) == ("J 1", "R 1", "kaggle")
    assert article.authors_parsed[1].asDict() == {
        "last_name": "Roe",
        "first_name": "A. B.",
        "other_name": "Jr",
    }
    assert article.title == "A title\n  in two lines" and article.abstract == "  Text.\n"
    assert art.drop_authors_parsed(normalised).columns == ARTICLE.names


def test_epoch_does_not_depend_on_the_session_zone(spark):
    rows_ = [("2016-05-04",), ("2024-06-30T12:00:00Z",), ("2024-06-30T12:00:00+02:00",)]
    df = spark.createDataFrame(rows_, "d string").select(
        art.update_epoch(F.col("d")), art.format_update_date(F.col("d"))
    )
    expected = [
        (1462320000, "2016-05-04T00:00:00"),
        (1719748800, "2024-06-30T12:00:00"),
        (1719741600, "2024-06-30T12:00:00"),
    ]
    try:
        for zone in ("UTC", "Europe/Zurich"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in df.collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_impossible_date_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE|INVALID"):
        one(spark, art.format_update_date(F.col("d")), "d string", "2024-02-31")


def test_string_order_of_versions(spark):
    schema = f"v array<{VERSION.simpleString()}>"
    versions = [(f"v{n}", None) for n in range(1, 11)]
    assert one(spark, art.latest_version(F.col("v")), schema, versions) == "v9"
    assert one(spark, art.latest_version(F.col("v"), numeric=True), schema, versions) == "v10"
    with pytest.raises(Exception, match="without versions"):
        one(spark, art.latest_version(F.col("v")), schema, [])


def test_author_parts(spark):
    schema = "a array<array<string>>"
    names = art.author_names(art.author_records(F.col("a")))
    people = [["Solo", "", ""], ["", "A", "X"], ["\tTab", "", "\n"]]
    assert one(spark, names, schema, people) == ["Solo", "A  X", "Tab"]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        one(spark, art.author_records(F.col("a")), schema, [["Doe", "J."]])
    lenient = art.author_records(F.col("a"), lenient=True)
    assert one(spark, lenient, schema, [["Doe", "J."]])[0].other_name is None


def test_category_split_keeps_empty_parts(spark):
    cut = art.split_categories(F.col("c"))
    assert one(spark, cut, "c string", "cs.AI  cs.LG") == ["cs.AI", "", "cs.LG"]
    assert one(spark, cut, "c string", "") == [""]


def test_api_ids(spark):
    found = art.id_from_link(F.col("l"))
    suffix, strict = art.version_suffix(found), art.version_suffix(found, strict=True)
    link = "http://arxiv.org/abs/2301.00001v12"
    assert one(spark, found, "l string", link) == "2301.00001v12"
    assert one(spark, suffix, "l string", link) == "12"
    assert one(spark, strict, "l string", link) == "v12"
    assert one(spark, found, "l string", "http://arxiv.org/abs/hep-ph/9901001v1") == "9901001v1"


def test_api_entry(spark):
    entry = (
        "http://arxiv.org/abs/2301.00001v1",
        None,
        "2023-01-01T00:00:00Z",
        "T",
        "S",
        [("A. B.",), ("C",)],
        None,
        "note",
        "J",
    )
    entries = spark.createDataFrame([entry], ENTRY)
    article = art.api_to_article(entries, "2024-06-30").first()
    assert article.update_date == "2024-06-30T00:00:00"
    assert article.authors == ["A. B.", "C"] and article.categories == []
    assert article.journal_ref is None and article.comments == "note"
    assert [v.asDict() for v in article.versions] == [
        {"version": "v1", "created": "2023-01-01T00:00:00Z"}
    ]
    assert art.api_to_article(entries, "2024-06-30", keep_journal_ref=True).first().journal_ref == "J"
    assert art.api_to_article(entries, "2024-06-30").columns == ARTICLE.names


def test_tokens_and_marks(spark):
    text = "Über-BERT's 2nd  façade, bert_bertBERT"
    expected = ["über", "bert", "s", "2nd", "façade", "bert", "bertbert"]
    assert one(spark, txt.tokens(F.col("t")), "t string", text) == expected
    assert one(spark, txt.tokens(F.col("t")), "t string", None) == []
    marked = txt.highlight(F.col("t"), F.array(F.lit("bert"), F.lit("über")))
    assert (
        one(spark, marked, "t string", text)
        == "<hi>Über</hi>-<hi>BERT</hi>'s 2nd  façade, <hi>bert</hi>_bertBERT"
    )
    assert one(spark, txt.show_marks(F.col("t"), "*"), "t string", "<hi>Sparse</hi> codes") == (
        "*Sparse* codes"
    )


def test_prefixes(spark):
    plain, prefixed = txt.passage_prefix(F.col("t")), txt.passage_prefix(
        F.col("t"), PASSAGE_PREFIX_MODEL
    )
    assert one(spark, plain, "t string", "x") == "x"
    assert one(spark, prefixed, "t string", "x") == "passage: x"
    assert one(spark, txt.query_prefix(F.col("t")), "t string", "x") == (
        "Represent this sentence for searching relevant passages:  x"
    )
    assert one(spark, txt.query_prefix(F.col("t"), ""), "t string", "x") == "x"
    asked = spark.createDataFrame([("Ab", "bm25"), ("Ab", "fusion")], "q string, p string")
    folded = asked.select(txt.query_casefold(F.col("q"), F.col("p")))
    assert rows(folded) == [("Ab",), ("ab",)]
