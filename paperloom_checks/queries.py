"""One query per operator. Each takes ``(spark, sf_dir)`` and returns flat, scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import (
    DAILY_BATCH,
    PASSAGE_PREFIX_MODEL,
    TARGET_HITS,
    VECTOR_SLICE_ROWS,
)
from paperloom.functions import articles as art
from paperloom.functions import text as txt
from paperloom.functions.encoders import hash_encoder
from paperloom.functions.vectors import l2_normalize
from paperloom.operators import attach, collection, embed, filters, paging, positions, textindex
from paperloom.operators.nearest import nearest
from paperloom.operators.topk import top_k
from paperloom.plans import daily, search
from paperloom.schemas import ARTICLE
from paperloom.session import scratch_path
from paperloom.sinks import articles as sink
from paperloom.sinks import feed
from paperloom.sources import atom, jsonl
from paperloom.sources import vectors as stored_vectors
from paperloom.streaming import cursor as cursors
from paperloom.streaming import ingest
from paperloom_checks import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def flat_article(rows: DataFrame) -> DataFrame:
    """Canonical articles with arrays as text."""
    versions = F.transform("versions", lambda x: F.concat_ws("@", x["version"], x["created"]))
    flat = {
        "authors": joined(F.col("authors")),
        "categories": joined(F.col("categories")),
        "versions": joined(versions),
    }
    return rows.select(*[flat.get(n, F.col(n)).alias(n) for n in ARTICLE.names])


# Sources and sinks


@query
def scan_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    sink.write_jsonl(v.raw_articles(spark, sf_dir), path)
    authors = F.transform("authors_parsed", lambda a: F.array_join(a, ","))
    versions = joined(F.col("versions")["version"])
    return jsonl.scan_snapshot(spark, path).select(
        "id",
        "submitter",
        "title",
        "comments",
        F.col("journal-ref").alias("journal_ref"),
        "categories",
        "abstract",
        "update_date",
        versions.alias("versions"),
        joined(authors).alias("authors_parsed"),
    )


@query
def scan_articles(spark, sf_dir):
    path = scratch_path(spark, "articles")
    rows = v.articles(spark, sf_dir).withColumns(
        {
            "categories": F.when(F.col("comments").isNotNull(), F.col("categories")),
            "abstract": F.when(F.col("journal_ref").isNotNull(), F.col("abstract")),
        }
    )
    sink.write_jsonl(rows, path)
    return flat_article(jsonl.scan_articles(spark, path))


@query
def scan_atom_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    v.api_entries(spark, sf_dir).groupBy("page").agg(_page_xml().alias("value")).write.parquet(path)
    entries = atom.parse_atom_pages(spark.read.parquet(path))
    return entries.select(
        "page",
        "pos",
        "page_rows",
        "id",
        "updated",
        "title",
        F.col("summary").alias("abstract"),
        joined(art.names_of(F.col("author"))).alias("authors"),
        joined(art.terms_of(F.col("category"))).alias("categories"),
        "comment",
    )


def _page_xml() -> Column:
    """An Atom document of all entries of a page, in page order."""

    def escaped(value: Column) -> Column:
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = F.replace(value, F.lit(char), F.lit(name))
        return value

    def element(tag: str, value: Column) -> Column:
        return F.coalesce(
            F.concat(F.lit(f"<{tag}>"), escaped(value), F.lit(f"</{tag}>")), F.lit("")
        )

    people = F.transform(
        "author",
        lambda a: F.concat(F.lit("<author>"), element("name", a["name"]), F.lit("</author>")),
    )
    tags = F.transform(
        "category", lambda c: F.concat(F.lit('<category term="'), c["_term"], F.lit('"/>'))
    )
    entry = F.concat(
        F.lit("<entry>"),
        *[element(c, F.col(c)) for c in ("id", "updated", "published", "title", "summary")],
        F.array_join(people, ""),
        F.array_join(tags, ""),
        element("arxiv:comment", F.col("comment")),
        F.lit("</entry>"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", entry.alias("xml"))))
    return F.concat(
        F.lit(
            '<feed xmlns="http://www.w3.org/2005/Atom" '
            'xmlns:arxiv="http://arxiv.org/schemas/atom">'
        ),
        F.array_join(in_order["xml"], "\n"),
        F.lit("</feed>"),
    )


@query
def scan_embeddings_range(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    sink.write_embeddings(v.vectors(spark, sf_dir), path)
    stored = stored_vectors.scan_embeddings(spark, path)
    part = stored_vectors.scan_embeddings_range(stored, 100, VECTOR_SLICE_ROWS)
    return part.select("id", "pos", F.round(_total(F.col("embedding")), 5).alias("total"))


def _total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _two_runs(spark, sf_dir):
    path = scratch_path(spark, "dated")
    bulk = v.articles(spark, sf_dir)
    sink.write_dated_overwrite(collection.union_origins(bulk, bulk), path, v.NEXT_RUN_DATE)
    sink.write_dated_overwrite(_api_articles(spark, sf_dir).select(*ARTICLE.names), path, v.RUN_DATE)
    sink.write_dated_overwrite(bulk.select(*ARTICLE.names), path, v.NEXT_RUN_DATE)
    return path


def _api_articles(spark, sf_dir):
    return art.api_to_article(v.api_entries(spark, sf_dir), v.RUN_DATE)


@query
def scan_dated_partition(spark, sf_dir):
    rows = jsonl.scan_dated_partition(spark, _two_runs(spark, sf_dir), v.RUN_DATE)
    return flat_article(rows)


@query
def scan_sample(spark, sf_dir):
    scan = v.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return jsonl.scan_sample(positions.parquet_positions(scan)).select("pos", "doc_id", "source")


@query
def write_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    sink.write_jsonl(v.articles(spark, sf_dir).select(*ARTICLE.names), path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.abstract").alias("abstract"),
        F.get_json_object("value", "$.update_date_ts").cast("bigint").alias("update_date_ts"),
        F.contains("value", F.lit('"doi":null')).alias("doi_is_written"),
        F.contains("value", F.lit('"comments":null')).alias("comments_are_null"),
    )


@query
def write_dated_overwrite(spark, sf_dir):
    rows = spark.read.json(
        _two_runs(spark, sf_dir), schema="id string, origin string, ingest_date string"
    )
    return rows.groupBy("ingest_date", "origin").agg(
        F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query
def write_embeddings(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    sink.write_embeddings(v.vectors(spark, sf_dir), path)
    return stored_vectors.scan_embeddings(spark, path).select(
        "id", "pos", F.round(_total(F.col("embedding")), 5).alias("total")
    )


@query
def feed_documents(spark, sf_dir):
    path = scratch_path(spark, "feed")
    kept = attach.attach_embeddings(v.articles(spark, sf_dir), v.vectors(spark, sf_dir), check=False)
    feed.feed_documents(kept, path=path)
    return feed.read_fed(spark, path).select(
        "id",
        F.col("fields.title").alias("title"),
        F.col("fields.origin").alias("origin"),
        joined(F.col("fields.categories")).alias("categories"),
        F.round(_total(F.col("fields.abstract_embedding.values")), 5).alias("total"),
    )


@query
def upsert_articles(spark, sf_dir):
    """Two loads and a repeat: the daily rows replace those bulk rows that share their id."""
    path = scratch_path(spark, "collection")
    daily_rows = _api_articles(spark, sf_dir)
    sink.upsert_articles(spark, path, v.articles(spark, sf_dir), 1)
    for _ in range(2):
        sink.upsert_articles(spark, path, daily_rows, 2)
    return flat_article(sink.stored_collection(spark, path))


# Projections


@query
def rename_fields(spark, sf_dir):
    return art.rename_fields(v.raw_articles(spark, sf_dir)).select(
        "id", "journal_ref", "report_no", "comments"
    )


@query
def split_categories(spark, sf_dir):
    cut = art.split_categories(F.col("categories"))
    return v.raw_articles(spark, sf_dir).select(
        "id", F.size(cut).alias("n_categories"), joined(cut).alias("categories")
    )


@query
def author_records(spark, sf_dir):
    records = art.author_records(F.col("authors_parsed"))
    return v.raw_articles(spark, sf_dir).select("id", F.explode(records).alias("a")).select(
        "id", "a.last_name", "a.first_name", "a.other_name"
    )


@query
def author_names(spark, sf_dir):
    names = art.author_names(art.author_records(F.col("authors_parsed")))
    return v.raw_articles(spark, sf_dir).select("id", joined(names).alias("authors"))


@query
def format_update_date(spark, sf_dir):
    return v.raw_articles(spark, sf_dir).select(
        "id", art.format_update_date(F.col("update_date")).alias("update_date")
    )


@query
def update_epoch(spark, sf_dir):
    return v.raw_articles(spark, sf_dir).select(
        "id", art.update_epoch(F.col("update_date")).alias("update_date_ts")
    )


@query
def origin_tag(spark, sf_dir):
    both = collection.union_origins(v.articles(spark, sf_dir), _api_articles(spark, sf_dir))
    return both.groupBy("origin").agg(F.count("*").alias("n_rows"))


@query
def latest_version(spark, sf_dir):
    return v.raw_articles(spark, sf_dir).select(
        "id",
        art.latest_version(F.col("versions")).alias("latest"),
        art.latest_version(F.col("versions"), numeric=True).alias("latest_numeric"),
    )


@query
def versioned_link(spark, sf_dir):
    version = art.latest_version(F.col("versions"))
    return v.raw_articles(spark, sf_dir).select(
        "id", art.versioned_link(F.col("id"), version).alias("link")
    )


@query
def versioned_id(spark, sf_dir):
    version = art.latest_version(F.col("versions"))
    return v.raw_articles(spark, sf_dir).select(
        art.versioned_id(F.col("id"), version).alias("id"), "title"
    )


@query
def id_from_link(spark, sf_dir):
    return v.api_entries(spark, sf_dir).select(
        F.col("id").alias("link"), art.id_from_link(F.col("id")).alias("id")
    )


@query
def version_suffix(spark, sf_dir):
    found = art.id_from_link(F.col("id"))
    return v.api_entries(spark, sf_dir).select(
        found.alias("id"),
        art.version_suffix(found).alias("version"),
        art.version_suffix(found, strict=True).alias("version_strict"),
    )


@query
def extract_terms(spark, sf_dir):
    return v.api_entries(spark, sf_dir).select(
        "id",
        joined(art.terms_of(F.col("category"))).alias("categories"),
        joined(art.names_of(F.col("author"))).alias("authors"),
    )


@query
def api_to_article(spark, sf_dir):
    return flat_article(_api_articles(spark, sf_dir))


@query
def bulk_to_article(spark, sf_dir):
    return flat_article(v.articles(spark, sf_dir))


@query
def drop_authors_parsed(spark, sf_dir):
    left = art.drop_authors_parsed(v.articles(spark, sf_dir))
    return flat_article(left).withColumn("n_columns", F.lit(len(left.columns)))


@query
def feed_document(spark, sf_dir):
    kept = attach.attach_embeddings(v.articles(spark, sf_dir), v.vectors(spark, sf_dir), check=False)
    document = art.feed_document(kept).select(F.to_json(F.struct("id", "fields")).alias("d"))
    values = F.from_json(F.get_json_object("d", "$.fields.abstract_embedding.values"), "array<float>")
    categories = F.from_json(F.get_json_object("d", "$.fields.categories"), "array<string>")
    units = F.transform(values, lambda x: F.floor(x.cast("double") * 100_000 + 0.5).cast("string"))
    return document.select(
        F.get_json_object("d", "$.id").alias("id"),
        F.get_json_object("d", "$.fields.link").alias("link"),
        F.array_join(categories, ",").alias("categories"),
        F.get_json_object("d", "$.fields.abstract").alias("abstract"),
        F.array_join(units, ",").alias("vector_units"),
    )


@query
def passage_prefix(spark, sf_dir):
    abstract = F.col("abstract")
    return v.articles(spark, sf_dir).select(
        "id",
        txt.passage_prefix(abstract).alias("plain"),
        txt.passage_prefix(abstract, PASSAGE_PREFIX_MODEL).alias("prefixed"),
    )


@query
def query_prefix(spark, sf_dir):
    text = F.col("query_text")
    return v.requests(spark, sf_dir).select(
        "query_id",
        txt.query_prefix(text).alias("prefixed"),
        txt.query_prefix(text, "").alias("plain"),
    )


@query
def query_casefold(spark, sf_dir):
    typed = F.concat(F.lit("Deep LEARNING "), F.col("query_text"))
    return v.requests(spark, sf_dir).select(
        "query_id", "profile", txt.query_casefold(typed, F.col("profile")).alias("query_text")
    )


@query
def result_cards(spark, sf_dir):
    marked = search.highlight_matches(_bm25_found(spark, sf_dir), v.requests(spark, sf_dir))
    return search.result_cards(marked)


@query
def batch_ranges(spark, sf_dir):
    numbered = positions.parquet_positions(v.table(spark, sf_dir, "documents").select("doc_id"))
    return positions.batch_ranges(numbered, DAILY_BATCH)


# Filters


@query
def filter_categories(spark, sf_dir):
    kept = filters.filter_categories(v.articles(spark, sf_dir), v.SUBSET)
    return kept.select("id", joined(F.col("categories")).alias("categories"))


@query
def filter_categories_ci(spark, sf_dir):
    kept = filters.filter_categories_ci(v.articles(spark, sf_dir), v.SUBSET)
    return kept.select("id", joined(F.col("categories")).alias("categories"))


@query
def filter_query_category(spark, sf_dir):
    """Every (request, article) pair of a matching term, before and after the filter."""
    index = textindex.index_articles(v.articles(spark, sf_dir))
    terms = search.request_terms(v.requests(spark, sf_dir))
    matched = search.match_requests(search.matches_for(index, terms), terms)
    kept = filters.filter_query_category(matched)
    return kept.groupBy("query_id").agg(
        F.count("*").alias("n_matches"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query
def filter_restart(spark, sf_dir):
    scan = v.table(spark, sf_dir, "documents").select("doc_id")
    numbered = positions.parquet_positions(scan)
    return filters.filter_restart(numbered, 100).select("pos", "doc_id")


@query
def filter_cap(spark, sf_dir):
    scan = v.table(spark, sf_dir, "documents").select("doc_id")
    return filters.filter_cap(positions.parquet_positions(scan), 700).select("pos", "doc_id")


@query
def filter_full_pages(spark, sf_dir):
    full = paging.filter_full_pages(v.api_entries(spark, sf_dir), v.PAGE_SIZE)
    return full.select("page", "pos", "id")


def _cutoff(spark, sf_dir):
    floor = F.lit(v.CURSOR).cast("timestamp_ntz") - F.expr("interval 3 hours")
    return paging.filter_page_cutoff(
        v.api_entries(spark, sf_dir),
        floor,
        F.to_timestamp_ntz("updated"),
        filters.in_categories(art.terms_of(F.col("category")), v.SUBSET),
    )


@query
def filter_page_cutoff(spark, sf_dir):
    return _cutoff(spark, sf_dir).select("page", "pos", "id", "updated")


@query
def filter_page_limit(spark, sf_dir):
    return paging.filter_page_limit(v.api_entries(spark, sf_dir), 15).select("page", "pos", "id")


@query
def filter_blank_query(spark, sf_dir):
    """Requests of one profile are blanked first, so that there are both kinds."""
    spoiled = v.requests(spark, sf_dir).withColumn(
        "query_text", F.when(F.col("profile") != "fusion", F.col("query_text")).otherwise("")
    )
    return filters.filter_blank_query(spoiled).select("query_id", "query_text", "profile")


# Joins


@query
def attach_embeddings(spark, sf_dir):
    kept = filters.filter_categories_ci(v.articles(spark, sf_dir), v.SUBSET)
    found = attach.attach_embeddings(kept.select("id", "title"), v.vectors(spark, sf_dir), check=False)
    return found.select("id", "title", F.round(_total(F.col("embedding")), 5).alias("total"))


@query
def attach_embeddings_positional(spark, sf_dir):
    """Keyless vectors: both sides go to files in the same order and are joined by place."""
    keyed = attach.attach_embeddings(
        v.articles(spark, sf_dir).select("id", "title", "categories"),
        v.vectors(spark, sf_dir),
        check=False,
    )
    ordered = keyed.repartitionByRange("id").sortWithinPartitions("id")
    files = scratch_path(spark, "ordered")
    ordered.write.parquet(files)
    both = spark.read.parquet(files)
    lines = scratch_path(spark, "lines")
    both.select("id", "title", "categories").orderBy("id").write.json(lines)
    kept = spark.read.schema("id string, title string, categories array<string>").json(lines)
    kept = kept.where(filters.in_categories_ci(F.col("categories"), v.SUBSET))
    numbered = positions.row_positions(positions.stage_in_file_order(kept))
    numbers = scratch_path(spark, "numbers")
    matrix = both.where(filters.in_categories_ci(F.col("categories"), v.SUBSET))
    matrix.select("embedding", "id").orderBy("id").write.parquet(numbers)
    keyless = positions.parquet_positions(spark.read.parquet(numbers).select("embedding"))
    found = attach.attach_embeddings_positional(numbered, keyless)
    return found.select("pos", "id", "title", F.round(_total(F.col("embedding")), 5).alias("total"))


@query
def match_terms(spark, sf_dir):
    index = textindex.index_articles(v.articles(spark, sf_dir))
    terms = search.request_terms(v.requests(spark, sf_dir))
    return search.matches_for(index, terms).postings.select("id", "term", "tf", "dl")


@query
def match_vectors(spark, sf_dir):
    found = nearest(v.vectors(spark, sf_dir), v.query_vectors(spark, sf_dir), TARGET_HITS)
    return found.select("query_id", "id", "cosine")


@query
def merge_candidates(spark, sf_dir):
    """All text matches and the nearest candidates of every request, as one list."""
    index = textindex.index_articles(v.articles(spark, sf_dir))
    terms = search.request_terms(v.requests(spark, sf_dir))
    scored = search.score_text(index, terms)
    near = nearest(v.vectors(spark, sf_dir), v.query_vectors(spark, sf_dir), TARGET_HITS)
    return search.merge_candidates(scored.select("query_id", "id", "text"), near)


def _bm25_found(spark, sf_dir):
    index = textindex.index_articles(v.articles(spark, sf_dir))
    hits = search.search_bm25(index, v.requests(spark, sf_dir))
    return search.hydrate_hits(hits, v.articles(spark, sf_dir), _n_hits(spark, sf_dir))


def _n_hits(spark, sf_dir):
    return v.requests(spark, sf_dir).count() * search.HITS


@query
def hydrate_hits(spark, sf_dir):
    found = _bm25_found(spark, sf_dir)
    return found.select(
        "query_id",
        "rank",
        "id",
        "relevance",
        "title",
        "abstract",
        joined(F.col("categories")).alias("categories"),
    )


# Aggregations


@query
def count_rows(spark, sf_dir):
    return collection.count_rows(v.raw_articles(spark, sf_dir))


@query
def feed_counters(spark, sf_dir):
    keep = filters.in_categories_ci(F.col("categories"), v.SUBSET)
    return collection.feed_counters(v.articles(spark, sf_dir), keep)


@query
def fetch_counter(spark, sf_dir):
    full = paging.filter_full_pages(v.api_entries(spark, sf_dir), v.PAGE_SIZE)
    return paging.fetch_counter(full, v.PAGE_SIZE)


@query
def max_update_date(spark, sf_dir):
    stored = _api_articles(spark, sf_dir)
    return paging.max_update_date(stored, F.col("update_date"))


@query
def mean_pool(spark, sf_dir):
    """Vectors of a label as the tokens of a document; the first value decides the mask."""
    tokens = v.table(spark, sf_dir, "embeddings")
    mask = F.get("embedding", F.lit(0)) > 0
    pooled = embed.mean_pool(tokens, "label", "embedding", mask, v.POOL_WIDTH)
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def term_stats(spark, sf_dir):
    return textindex.term_stats(textindex.index_articles(v.articles(spark, sf_dir)))


@query
def corpus_stats(spark, sf_dir):
    index = textindex.index_articles(v.articles(spark, sf_dir))
    return textindex.corpus_stats(index).withColumn("mean_length", F.round("mean_length", 6))


# Sort, top-k and positions


@query
def topk_hits(spark, sf_dir):
    """The ten most frequent uses of a request's terms."""
    index = textindex.index_articles(v.articles(spark, sf_dir))
    terms = search.request_terms(v.requests(spark, sf_dir))
    matched = search.match_requests(search.matches_for(index, terms), terms)
    scored = matched.groupBy("query_id", "id").agg(
        F.sum("tf").cast("double").alias("relevance")
    )
    return search.topk_hits(scored)


@query
def topk_candidates(spark, sf_dir):
    found = nearest(v.vectors(spark, sf_dir), v.query_vectors(spark, sf_dir))
    return found.select("query_id", "id", "cosine", "near_rank")


@query
def page_by_update(spark, sf_dir):
    rows = _api_articles(spark, sf_dir).select("id", "update_date")
    updated, last = F.col("update_date"), None
    for _ in range(2):  # resume behind the last row of each page
        last = paging.page_token(paging.page_after(rows, updated, last, v.PAGE_SIZE), updated)
    return paging.page_after(rows, updated, last, v.PAGE_SIZE)


@query
def row_positions(spark, sf_dir):
    """Line numbers of a snapshot that was written in id order, in many files."""
    path = scratch_path(spark, "lines")
    v.raw_articles(spark, sf_dir).select("id", "submitter").orderBy("id").write.json(path)
    scan = spark.read.schema("id string, submitter string").json(path)
    return positions.row_positions(positions.stage_in_file_order(scan))


# Sets


@query
def union_origins(spark, sf_dir):
    both = collection.union_origins(v.articles(spark, sf_dir), _api_articles(spark, sf_dir))
    return flat_article(both)


@query
def fold_subset(spark, sf_dir):
    """The subset as a folded set, and how many articles each of its members keeps."""
    members = [c for name in v.SUBSET for c in (name, name.upper())]
    kept = filters.filter_categories_ci(v.articles(spark, sf_dir), members)
    return kept.select(F.explode(filters.fold_subset(members)).alias("category"), "id").groupBy(
        "category"
    ).agg(F.count("*").alias("n_rows"))


# Search


def _asked(spark, sf_dir):
    return filters.filter_blank_query(v.requests(spark, sf_dir))


@query
def search_bm25(spark, sf_dir):
    index = textindex.index_articles(v.articles(spark, sf_dir))
    return search.search_bm25(index, _asked(spark, sf_dir))


@query
def search_semantic(spark, sf_dir):
    return search.search_semantic(v.vectors(spark, sf_dir), v.query_vectors(spark, sf_dir))


@query
def search_hybrid(spark, sf_dir):
    return search.search_hybrid(*_search_inputs(spark, sf_dir))


@query
def search_fusion(spark, sf_dir):
    return search.search_fusion(*_search_inputs(spark, sf_dir))


@query
def search_dispatch(spark, sf_dir):
    return search.search_dispatch(*_search_inputs(spark, sf_dir))


def _search_inputs(spark, sf_dir):
    return (
        textindex.index_articles(v.articles(spark, sf_dir)),
        v.vectors(spark, sf_dir),
        _asked(spark, sf_dir),
        v.query_vectors(spark, sf_dir),
    )


@query
def highlight_matches(spark, sf_dir):
    marked = search.highlight_matches(_bm25_found(spark, sf_dir), v.requests(spark, sf_dir))
    return marked.select("query_id", "rank", "id", "title", "abstract")


# Incremental


@query
def incremental_cursor(spark, sf_dir):
    """A daily run from a stored cursor: what it keeps, and the cursor it leaves."""
    state = scratch_path(spark, "cursor")
    cursors.write_cursor(spark, state, v.CURSOR)
    kept = daily.select_pages(
        v.api_entries(spark, sf_dir), cursors.read_cursor(spark, state), v.SUBSET
    )
    stored = art.api_to_article(kept, v.RUN_DATE)
    cursors.advance_cursor(spark, state, stored)
    return cursors.cursor_history(spark, state).select(
        "seq", F.unix_seconds("last_updated").alias("last_updated")
    )


@query
def stream_ingest(spark, sf_dir):
    """Two landings, each followed by a run of the stream."""
    landing, table, state = (scratch_path(spark, n) for n in ("landing", "table", "checkpoint"))
    for rows in (v.articles(spark, sf_dir), _api_articles(spark, sf_dir)):
        sink.write_jsonl(rows.select(*ARTICLE.names), landing, mode="append")
        ingest.stream_ingest(spark, landing, table, state, v.SUBSET).awaitTermination()
    return flat_article(sink.stored_collection(spark, table))


@query
def stream_dedup_overlap(spark, sf_dir):
    """The same articles landed twice are passed on once."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "out", "checkpoint"))
    for _ in range(2):
        rows = _api_articles(spark, sf_dir).select(*ARTICLE.names)
        sink.write_jsonl(rows, landing, mode="append")
        ingest.stream_dedup_overlap(spark, landing, out, state).awaitTermination()
    passed = spark.read.schema(ARTICLE).parquet(out)
    return passed.select("id", "update_date", "title")


# Embeddings


def _slots(embedded: DataFrame, key: str) -> DataFrame:
    """The non-zero values of every vector."""
    values = embedded.select(key, F.posexplode("embedding").alias("slot", "value"))
    return values.where("value <> 0").withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query
def embed_abstracts(spark, sf_dir):
    kept = filters.filter_categories(v.articles(spark, sf_dir), v.SUBSET)
    return _slots(embed.embed_abstracts(kept, hash_encoder()), "id")


@query
def embed_queries(spark, sf_dir):
    return _slots(embed.embed_queries(v.requests(spark, sf_dir), hash_encoder()), "query_id")


@query
def l2_normalize_vectors(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = v.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(l2_normalize(tripled)).alias("dim", "value")
    )
    return unit.withColumn("value", F.round("value", 6))


QUERIES["l2_normalize"] = QUERIES.pop("l2_normalize_vectors")
