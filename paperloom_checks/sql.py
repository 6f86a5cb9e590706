"""The SQL counterpart of every query, for DuckDB on the given tables.

Written from the definitions, not from the Spark plans: where Spark avoids comparing all
pairs or ordering a whole group, the SQL here just does it.
"""

from __future__ import annotations

from paperloom.constants import (
    BM25_B,
    BM25_K1,
    DAILY_BATCH,
    PASSAGE_PREFIX,
    QUERY_INSTRUCTION,
    RRF_K,
    SAMPLE_ROWS,
    TARGET_HITS,
    UPDATE_DATE_FORMAT,
    VECTOR_SLICE_ROWS,
)
from paperloom_checks.views import CURSOR, NEXT_RUN_DATE, PAGE_SIZE, RUN_DATE, SUBSET

assert UPDATE_DATE_FORMAT == "yyyy-MM-dd'T'HH:mm:ss"
DATE_TIME = "%Y-%m-%dT%H:%M:%S"

SUBSET_SQL = "[" + ", ".join(f"'{c}'" for c in SUBSET) + "]"
KEEP = f"list_has_any(categories, {SUBSET_SQL})"
KEEP_CI = f"list_has_any(list_transform(categories, lambda c: lower(c)), {SUBSET_SQL})"
TOTAL = "round(list_sum(embedding::DOUBLE[]), 5) AS total"


def raw_id(n: str) -> str:
    return f"('24' || lpad(({n} % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad({n}::VARCHAR, 12, '0'))"


def article_id(n: str) -> str:
    return f"({raw_id(n)} || 'v' || least({n} % 12 + 1, 9))"


def words(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


RAW = f"""
raw_articles AS (
  SELECT doc_id, {raw_id('doc_id')} AS id, source AS submitter,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN doc_id % 3 <> 0 THEN 'n ' || n_chars END AS comments,
    CASE WHEN doc_id % 4 = 0 THEN 'J ' || doc_id END AS journal_ref,
    CASE WHEN doc_id % 6 = 0 THEN 'R ' || doc_id END AS report_no,
    CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END || ' ' || source AS categories,
    text AS abstract,
    list_transform(range(1, doc_id % 12 + 2), lambda n: 'v' || n) AS versions,
    DATE '2024-01-01' + (doc_id % 365)::INT AS update_day,
    'Last' || doc_id % 7 AS last_name,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'F.' END AS first_name,
    CASE WHEN doc_id % 4 = 0 THEN 'Jr' ELSE '' END AS other_name
  FROM documents)"""

ARTICLES = f"""{RAW},
articles AS (
  SELECT doc_id, id || list_max(versions) AS id,
    'http://arxiv.org/abs/' || id || list_max(versions) AS link, submitter,
    [trim(first_name || ' ' || last_name || ' ' || other_name), 'J. Doe'] AS authors,
    title, comments, journal_ref, NULL::VARCHAR AS doi, report_no,
    string_split(categories, ' ') AS categories, NULL::VARCHAR AS license, abstract,
    list_transform(versions, lambda n: n || '@Mon, 1 Jan 2024 00:00:00 GMT') AS versions,
    strftime(update_day, '{DATE_TIME}') AS update_date,
    epoch(update_day)::BIGINT AS update_date_ts, 'kaggle' AS origin
  FROM raw_articles)"""

API = f"""
api_entries AS (
  SELECT doc_id, doc_id // {PAGE_SIZE} AS page, doc_id % {PAGE_SIZE} AS pos,
    'http://arxiv.org/abs/' || {raw_id('doc_id')} || 'v' || (doc_id % 12 + 1) AS link,
    TIMESTAMP '{RUN_DATE} 00:00:00' - to_minutes(doc_id) AS updated,
    split_part(text, chr(10), 1) AS title, text AS abstract,
    ['Author ' || doc_id % 7, 'J. Doe'] AS authors, [lang, source] AS categories,
    CASE WHEN doc_id % 3 <> 0 THEN 'n ' || n_chars END AS comments
  FROM documents),
api_articles AS (
  SELECT doc_id, page, pos, split_part(link, '/', -1) AS id, link, NULL::VARCHAR AS submitter,
    authors, title, comments, NULL::VARCHAR AS journal_ref, NULL::VARCHAR AS doi,
    NULL::VARCHAR AS report_no, categories, NULL::VARCHAR AS license, abstract,
    [right(split_part(link, '/', -1), 2) || '@2024-01-01T00:00:00Z'] AS versions,
    strftime(updated, '{DATE_TIME}') AS update_date, epoch(updated)::BIGINT AS update_date_ts,
    'arxiv_api' AS origin
  FROM api_entries)"""

REQUESTS = f"""
requests AS (
  SELECT item_id AS query_id,
    text AS query_text,
    ['bm25', 'semantic', 'hybrid', 'fusion'][item_id % 4 + 1] AS profile,
    CASE WHEN item_id % 8 = 0 THEN 'en' END AS category
  FROM benchmark),
terms AS (
  SELECT query_id, category, unnest(list_distinct({words('query_text')})) AS term,
    len(list_distinct({words('query_text')})) AS n_terms
  FROM requests WHERE query_text <> '')"""

VECTORS = f"""
vectors AS (SELECT vec_id, {article_id('vec_id')} AS id, embedding FROM embeddings),
cosines AS (
  SELECT q.vec_id AS query_id, v.id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings q JOIN requests r ON r.query_id = q.vec_id, vectors v),
near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS near_rank
    FROM cosines) WHERE near_rank <= 1000)"""

POSTINGS = f"""
tokenised AS (
  SELECT id, categories, {words("concat_ws(' ', title, abstract)")} AS tokens FROM articles),
lengths AS (SELECT id, categories, len(tokens)::BIGINT AS dl FROM tokenised),
corpus AS (SELECT count(*) AS n_articles, avg(dl) AS mean_length FROM lengths),
postings AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tokenised)
  GROUP BY ALL)"""

SCORED = f"""
weights AS (
  SELECT term, ln(1 + (n_articles - df + 0.5) / (df + 0.5)) AS idf, mean_length
  FROM (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term), corpus),
matches AS (
  SELECT t.query_id, t.category, t.n_terms, p.id, p.term, p.tf, l.dl, l.categories,
    w.idf * p.tf * ({BM25_K1} + 1)::DOUBLE
      / (p.tf + {BM25_K1}::DOUBLE * (1 - {BM25_B}::DOUBLE + {BM25_B}::DOUBLE * l.dl / w.mean_length))
      AS part
  FROM terms t JOIN postings p USING (term) JOIN lengths l USING (id) JOIN weights w USING (term)),
scored AS (
  SELECT query_id, id, round(sum(part), 6) AS text,
    row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 6) DESC, id) AS text_rank
  FROM matches GROUP BY query_id, id),
bm25 AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank
    FROM (
      SELECT query_id, id, round(sum(part), 6) AS relevance FROM matches
      WHERE category IS NULL OR list_contains(categories, category)
      GROUP BY query_id, id HAVING count(*) = max(n_terms))) WHERE rank <= 10)"""

BLENDS = f"""
asked_near AS (
  SELECT n.* FROM near n JOIN requests r USING (query_id)),
blended AS (
  SELECT query_id, id, coalesce(text, 0) AS text, coalesce(cosine, 0) AS cosine,
    text_rank, near_rank
  FROM scored FULL JOIN asked_near USING (query_id, id)),
hybrid AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank
    FROM (SELECT query_id, id, round(text + cosine, 6) AS relevance FROM blended))
  WHERE rank <= 10),
fusion AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank
    FROM (SELECT query_id, id,
            round(coalesce(1e0 / ({RRF_K} + text_rank), 0) + coalesce(1e0 / ({RRF_K} + near_rank), 0), 6)
              AS relevance FROM blended))
  WHERE rank <= 10),
semantic AS (
  SELECT query_id, id, cosine AS relevance, near_rank::INT AS rank FROM near WHERE near_rank <= 10)"""

SEARCH = ",".join([ARTICLES, REQUESTS, VECTORS, POSTINGS, SCORED, BLENDS])
TEXT_SEARCH = ",".join([ARTICLES, REQUESTS, POSTINGS, SCORED])


def flat(source: str, where: str = "") -> str:
    return f"""
  SELECT id, link, submitter, array_to_string(authors, '|') AS authors, title, comments,
    journal_ref, doi, report_no, array_to_string(categories, '|') AS categories, license,
    abstract, array_to_string(versions, '|') AS versions, update_date, update_date_ts, origin
  FROM {source} {where}"""


def marked(column: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, "
        "'[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda run: CASE WHEN list_contains(terms, lower(run)) "
        "THEN '<hi>' || run || '</hi>' ELSE run END), '')"
    )


MARKED = f"""{TEXT_SEARCH},
found AS (
  SELECT b.query_id, b.rank, b.id, b.relevance, a.title, a.abstract, a.categories, a.update_date,
    {words('r.query_text')} AS terms
  FROM bm25 b JOIN articles a USING (id) JOIN requests r USING (query_id)),
marked AS (
  SELECT query_id, rank, id, relevance, categories, update_date,
    {marked('title')} AS title, {marked('abstract')} AS abstract FROM found)"""


def slots(key: str, source: str) -> str:
    """One-hot slots of all tokens, pooled by mean and scaled to unit length."""
    return f"""
hashed AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % 384 AS slot
  FROM (SELECT {key}, unnest({words('text')}) AS token FROM {source})),
counted AS (SELECT {key}, slot, count(*)::DOUBLE AS n FROM hashed GROUP BY {key}, slot),
pooled AS (SELECT {key}, slot, n / sum(n) OVER (PARTITION BY {key}) AS value FROM counted)
SELECT {key}, slot::INT AS slot,
  round((value / sqrt(sum(value * value) OVER (PARTITION BY {key})))::FLOAT::DOUBLE, 6) AS value
FROM pooled"""


def over_matches(select: str) -> str:
    return f"WITH {TEXT_SEARCH} {select}"


SQL: dict[str, str] = {
    "scan_snapshot": f"""WITH {RAW}
SELECT id, submitter, title, comments, journal_ref, categories, abstract,
  strftime(update_day, '%Y-%m-%d') AS update_date, array_to_string(versions, '|') AS versions,
  last_name || ',' || first_name || ',' || other_name || '|Doe,J.,' AS authors_parsed
FROM raw_articles""",
    "scan_articles": f"""WITH {ARTICLES},
spoiled AS (
  SELECT * REPLACE (
    CASE WHEN comments IS NULL THEN [] ELSE categories END AS categories,
    CASE WHEN journal_ref IS NULL THEN '' ELSE abstract END AS abstract) FROM articles)
{flat('spoiled')}""",
    "scan_atom_pages": f"""WITH {API}
SELECT page, pos, (count(*) OVER (PARTITION BY page))::INT AS page_rows, link AS id,
  strftime(updated, '{DATE_TIME}Z') AS updated, title, abstract,
  array_to_string(authors, '|') AS authors, array_to_string(categories, '|') AS categories,
  comments AS comment
FROM api_entries""",
    "scan_embeddings_range": f"""
SELECT {article_id('vec_id')} AS id, vec_id AS pos, {TOTAL}
FROM embeddings WHERE vec_id >= 100 AND vec_id < {VECTOR_SLICE_ROWS}""",
    "scan_dated_partition": f"WITH {API} {flat('api_articles')}",
    "scan_sample": f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, source
FROM documents ORDER BY doc_id LIMIT {SAMPLE_ROWS}""",
    "write_jsonl": f"""WITH {ARTICLES}
SELECT id, abstract, update_date_ts, true AS doi_is_written, comments IS NULL AS comments_are_null
FROM articles""",
    "write_dated_overwrite": f"""WITH {ARTICLES}, {API}
SELECT ingest_date, origin, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id
FROM (SELECT '{NEXT_RUN_DATE}' AS ingest_date, origin, id FROM articles
      UNION ALL SELECT '{RUN_DATE}', origin, id FROM api_articles)
GROUP BY ingest_date, origin""",
    "write_embeddings": f"""
SELECT {article_id('vec_id')} AS id, vec_id AS pos, {TOTAL} FROM embeddings""",
    "feed_documents": f"""WITH {ARTICLES}
SELECT id, title, origin, array_to_string(categories, '|') AS categories, {TOTAL}
FROM articles JOIN embeddings ON vec_id = doc_id""",
    "upsert_articles": f"""WITH {ARTICLES}, {API},
latest AS (
  SELECT * EXCLUDE (page, pos) FROM api_articles
  UNION ALL BY NAME
  SELECT * FROM articles WHERE id NOT IN (SELECT id FROM api_articles))
{flat('latest')}""",
    "rename_fields": f"WITH {RAW} SELECT id, journal_ref, report_no, comments FROM raw_articles",
    "split_categories": f"""WITH {RAW}
SELECT id, len(string_split(categories, ' '))::INT AS n_categories,
  array_to_string(string_split(categories, ' '), '|') AS categories FROM raw_articles""",
    "author_records": f"""WITH {RAW}
SELECT id, last_name, first_name, other_name FROM raw_articles
UNION ALL SELECT id, 'Doe', 'J.', '' FROM raw_articles""",
    "author_names": f"""WITH {RAW}
SELECT id, trim(first_name || ' ' || last_name || ' ' || other_name) || '|J. Doe' AS authors
FROM raw_articles""",
    "format_update_date": f"""WITH {RAW}
SELECT id, strftime(update_day, '{DATE_TIME}') AS update_date FROM raw_articles""",
    "update_epoch": f"""WITH {RAW}
SELECT id, epoch(update_day)::BIGINT AS update_date_ts FROM raw_articles""",
    "origin_tag": """
SELECT unnest(['kaggle', 'arxiv_api']) AS origin, count(*) AS n_rows FROM documents""",
    "latest_version": f"""WITH {RAW}
SELECT id, list_max(versions) AS latest, 'v' || len(versions) AS latest_numeric
FROM raw_articles""",
    "versioned_link": f"""WITH {RAW}
SELECT id, 'http://arxiv.org/abs/' || id || list_max(versions) AS link FROM raw_articles""",
    "versioned_id": f"WITH {RAW} SELECT id || list_max(versions) AS id, title FROM raw_articles",
    "id_from_link": f"WITH {API} SELECT link, split_part(link, '/', -1) AS id FROM api_entries",
    "version_suffix": f"""WITH {API}
SELECT split_part(link, '/', -1) AS id, right(link, 2) AS version,
  regexp_extract(link, '(v[0-9]+)$', 1) AS version_strict FROM api_entries""",
    "extract_terms": f"""WITH {API}
SELECT link AS id, array_to_string(categories, '|') AS categories,
  array_to_string(authors, '|') AS authors FROM api_entries""",
    "api_to_article": f"WITH {API} {flat('api_articles')}",
    "bulk_to_article": f"WITH {ARTICLES} {flat('articles')}",
    "drop_authors_parsed": f"""WITH {ARTICLES}
SELECT *, 16 AS n_columns FROM ({flat('articles')})""",
    "feed_document": f"""WITH {ARTICLES}
SELECT id, link, array_to_string(categories, ',') AS categories, abstract,
  array_to_string([floor(x::DOUBLE * 100000 + 0.5)::BIGINT::VARCHAR for x in embedding], ',') AS vector_units
FROM articles JOIN embeddings ON vec_id = doc_id""",
    "passage_prefix": f"""WITH {ARTICLES}
SELECT id, abstract AS plain, '{PASSAGE_PREFIX}' || abstract AS prefixed FROM articles""",
    "query_prefix": f"""WITH {REQUESTS}
SELECT query_id, '{QUERY_INSTRUCTION}' || ' ' || query_text AS prefixed, query_text AS plain
FROM requests""",
    "query_casefold": f"""WITH {REQUESTS}
SELECT query_id, profile,
  CASE WHEN profile IN ('hybrid', 'fusion') THEN 'deep learning ' || lower(query_text)
    ELSE 'Deep LEARNING ' || query_text END AS query_text
FROM requests""",
    "result_cards": f"""WITH {MARKED}
SELECT query_id, rank, id,
  '[**' || replace(replace(title, '<hi>', '*'), '</hi>', '*') || '**](https://arxiv.org/abs/'
    || id || ')' AS title,
  printf('Relevance: %10f', relevance) AS relevance, array_to_string(categories, ' ') AS categories,
  update_date, replace(replace(abstract, '<hi>', '**'), '</hi>', '**') AS abstract
FROM marked""",
    "batch_ranges": f"""
SELECT pos // {DAILY_BATCH} AS batch_id, min(pos) AS range_start, max(pos) + 1 AS range_end,
  count(*) AS n_rows
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1""",
    "filter_categories": f"""WITH {ARTICLES}
SELECT id, array_to_string(categories, '|') AS categories FROM articles WHERE {KEEP}""",
    "filter_categories_ci": f"""WITH {ARTICLES}
SELECT id, array_to_string(categories, '|') AS categories FROM articles WHERE {KEEP_CI}""",
    "filter_query_category": over_matches("""
SELECT query_id, count(*) AS n_matches, min(id) AS first_id, max(id) AS last_id FROM matches
WHERE category IS NULL OR list_contains(categories, category) GROUP BY query_id"""),
    "filter_restart": """
SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents)
WHERE pos >= 100""",
    "filter_cap": f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents)
WHERE pos <= 700""",
    "filter_full_pages": f"""WITH {API}
SELECT page, pos, link AS id FROM api_entries
QUALIFY count(*) OVER (PARTITION BY page) = {PAGE_SIZE}""",
    "filter_page_cutoff": f"""WITH {API},
newest AS (
  SELECT page, arg_min(updated, pos) AS newest FROM api_entries WHERE {KEEP} GROUP BY page),
stop AS (
  SELECT min(page) AS page FROM newest
  WHERE newest < TIMESTAMP '{CURSOR}' - INTERVAL 3 HOURS)
SELECT e.page, pos, link AS id, strftime(updated, '{DATE_TIME}Z') AS updated
FROM api_entries e, stop s WHERE s.page IS NULL OR e.page <= s.page""",
    "filter_page_limit": f"""WITH {API}
SELECT page, pos, link AS id FROM api_entries WHERE page <= 15""",
    "filter_blank_query": f"""WITH {REQUESTS}
SELECT query_id, query_text, profile FROM requests WHERE query_text <> '' AND profile <> 'fusion'""",
    "attach_embeddings": f"""WITH {ARTICLES}
SELECT id, title, {TOTAL} FROM articles JOIN embeddings ON vec_id = doc_id WHERE {KEEP_CI}""",
    "attach_embeddings_positional": f"""WITH {ARTICLES}
SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, title, {TOTAL}
FROM articles JOIN embeddings ON vec_id = doc_id WHERE {KEEP_CI}""",
    "match_terms": f"""WITH {ARTICLES}, {REQUESTS}, {POSTINGS}
SELECT id, term, tf, dl::INT AS dl FROM postings JOIN lengths USING (id)
WHERE term IN (SELECT term FROM terms)""",
    "match_vectors": f"""WITH {REQUESTS}, {VECTORS}
SELECT query_id, id, cosine FROM near WHERE near_rank <= {TARGET_HITS}""",
    "merge_candidates": f"""WITH {SEARCH}
SELECT query_id, id, coalesce(text, 0) AS text, coalesce(cosine, 0) AS cosine,
  near_rank::INT AS near_rank
FROM scored FULL JOIN (SELECT * FROM near WHERE near_rank <= {TARGET_HITS}) USING (query_id, id)""",
    "hydrate_hits": f"""WITH {TEXT_SEARCH}
SELECT query_id, rank, id, relevance, title, abstract,
  array_to_string(categories, '|') AS categories
FROM bm25 JOIN articles USING (id)""",
    "count_rows": "SELECT count(*) AS n_rows FROM documents",
    "feed_counters": f"""WITH {ARTICLES}
SELECT count(*) AS processed, count(*) FILTER ({KEEP_CI}) AS ingested,
  count(*) FILTER (NOT {KEEP_CI}) AS skipped FROM articles""",
    "fetch_counter": f"""WITH {API}
SELECT count(*) * {PAGE_SIZE} AS fetched
FROM (SELECT page FROM api_entries GROUP BY page HAVING count(*) = {PAGE_SIZE})""",
    "max_update_date": f"WITH {API} SELECT max(update_date) AS last_updated FROM api_articles",
    "mean_pool": """
WITH used AS (
  SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings WHERE embedding[1] > 0)
SELECT label, dim::INT AS dim, round(avg(value::DOUBLE), 6) AS value FROM used GROUP BY label, dim""",
    "term_stats": f"""WITH {ARTICLES}, {POSTINGS}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term""",
    "corpus_stats": f"""WITH {ARTICLES}, {POSTINGS}
SELECT n_articles, round(mean_length, 6) AS mean_length FROM corpus""",
    "topk_hits": over_matches("""
SELECT query_id, id, relevance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank FROM (
    SELECT query_id, id, sum(tf)::DOUBLE AS relevance FROM matches GROUP BY query_id, id))
WHERE rank <= 10"""),
    "topk_candidates": f"""WITH {REQUESTS}, {VECTORS}
SELECT query_id, id, cosine, near_rank::INT AS near_rank FROM near""",
    "page_by_update": f"""WITH {API}
SELECT id, update_date FROM api_articles
ORDER BY update_date DESC, id LIMIT {PAGE_SIZE} OFFSET {2 * PAGE_SIZE}""",
    "row_positions": f"""WITH {RAW}
SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, submitter FROM raw_articles""",
    "union_origins": f"""WITH {ARTICLES}, {API},
both_origins AS (
  SELECT * FROM articles UNION ALL BY NAME SELECT * EXCLUDE (page, pos) FROM api_articles)
{flat('both_origins')}""",
    "fold_subset": f"""WITH {ARTICLES}
SELECT unnest({SUBSET_SQL}) AS category, count(*) AS n_rows FROM articles WHERE {KEEP_CI}""",
    "search_bm25": f"WITH {TEXT_SEARCH} SELECT query_id, rank, id, relevance FROM bm25",
    "search_semantic": f"WITH {SEARCH} SELECT query_id, rank, id, relevance FROM semantic",
    "search_hybrid": f"WITH {SEARCH} SELECT query_id, rank, id, relevance FROM hybrid",
    "search_fusion": f"WITH {SEARCH} SELECT query_id, rank, id, relevance FROM fusion",
    "search_dispatch": f"""WITH {SEARCH}
SELECT query_id, rank, id, relevance, profile
FROM (
  SELECT *, 'bm25' AS profile FROM bm25 UNION ALL BY NAME
  SELECT *, 'semantic' AS profile FROM semantic UNION ALL BY NAME
  SELECT *, 'hybrid' AS profile FROM hybrid UNION ALL BY NAME
  SELECT *, 'fusion' AS profile FROM fusion)
JOIN requests USING (query_id, profile)""",
    "highlight_matches": f"WITH {MARKED} SELECT query_id, rank, id, title, abstract FROM marked",
    "incremental_cursor": f"""WITH {API},
full_pages AS (
  SELECT * FROM api_entries WHERE page <= 15
  QUALIFY count(*) OVER (PARTITION BY page) = {PAGE_SIZE}),
newest AS (
  SELECT page, arg_min(updated, pos) AS newest FROM full_pages WHERE {KEEP} GROUP BY page),
stop AS (
  SELECT min(page) AS page FROM newest
  WHERE newest < TIMESTAMP '{CURSOR}' - INTERVAL 3 HOURS)
SELECT 0::BIGINT AS seq, epoch(TIMESTAMP '{CURSOR}')::BIGINT AS last_updated
UNION ALL
SELECT 1, epoch(max(updated))::BIGINT
FROM full_pages e, stop s WHERE {KEEP} AND (s.page IS NULL OR e.page <= s.page)""",
    "stream_ingest": f"""WITH {ARTICLES}, {API},
latest AS (
  SELECT * EXCLUDE (page, pos) FROM api_articles WHERE {KEEP_CI}
  UNION ALL BY NAME
  SELECT * FROM articles
  WHERE {KEEP_CI} AND id NOT IN (SELECT id FROM api_articles WHERE {KEEP_CI}))
{flat('latest')}""",
    "stream_dedup_overlap": f"WITH {API} SELECT id, update_date, title FROM api_articles",
    "embed_abstracts": f"""WITH {ARTICLES},
kept AS (SELECT id, abstract AS text FROM articles WHERE {KEEP}), {slots('id', 'kept')}""",
    "embed_queries": f"""WITH {REQUESTS},
kept AS (SELECT query_id, '{QUERY_INSTRUCTION}' || ' ' || query_text AS text FROM requests),
{slots('query_id', 'kept')}""",
    "l2_normalize": """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
measured AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM scaled)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS dim, round(unnest(v) / n, 6) AS value
FROM measured""",
}
