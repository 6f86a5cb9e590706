"""Fixed values shared by every job.

These decide results (or name a public format) and are kept together, as plain values.
"""

# Default subject categories, in alphabetical order.
DEFAULT_CATEGORIES = [
    "cs.AI",
    "cs.CL",
    "cs.CV",
    "cs.CY",
    "cs.DB",
    "cs.DL",
    "cs.HR",
    "cs.IR",
    "cs.LG",
    "cs.NE",
    "cs.PL",
    "cs.SE",
]

# Provenance tags of the two ingests.
BULK_ORIGIN = "kaggle"
API_ORIGIN = "arxiv_api"

LINK_PREFIX = "http://arxiv.org/abs/"

# Spark datetime pattern of the stored update date.
UPDATE_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# Embedding model families: one wants its passages prefixed, the other its queries.
PASSAGE_PREFIX_MODEL = "intfloat/e5-small-v2"
PASSAGE_PREFIX = "passage: "
DEFAULT_MODEL = "BAAI/bge-small-en-v1.5"
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "

EMBEDDING_WIDTH = 384
MAX_TOKENS = 512
DAILY_BATCH = 48
BULK_BATCH = 192
VECTOR_CHUNK_ROWS = 768
VECTOR_SLICE_ROWS = 38_400

FEED_BATCH = 500
FEED_FLUSH = 5_000
FEED_CAP = 2_500_000
NO_RESTART = -1

API_PAGE_SIZE = 1_000
API_LAST_PAGE = 100
SAMPLE_ROWS = 1_000

CURSOR_MARGIN = "3 hours"
SEED_MARGIN = "3 days"

TARGET_HITS = 1_000
HITS = 10

SEARCH_PROFILES = ("bm25", "semantic", "hybrid", "fusion")

# Okapi BM25 and reciprocal-rank-fusion parameters.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60

# Scores are rounded before they are ranked, so that float noise cannot reorder ties.
SCORE_DIGITS = 6
