"""Explicit schemas and the constants that decide results."""

from __future__ import annotations

from pyspark.sql import types as T

ARCHIVE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("url_key", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("excerpt", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("content_hash", T.StringType()),
    T.StructField("first_seen", T.LongType()), T.StructField("last_seen", T.LongType()), T.StructField("visit_count", T.IntegerType()),
    T.StructField("pinned", T.BooleanType()), T.StructField("bytes", T.LongType()), T.StructField("lang", T.StringType()),
])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.LongType()), T.StructField("tf", T.IntegerType()), T.StructField("pos", T.ArrayType(T.IntegerType()))])
LOG = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("count", T.LongType()),
    T.StructField("bytes_freed", T.LongType()), T.StructField("age", T.LongType()), T.StructField("size", T.LongType()), T.StructField("rounds", T.LongType()),
])
PAGE_INPUT = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("last_seen", T.LongType()),
    T.StructField("pinned", T.BooleanType()), T.StructField("first_seen", T.LongType()), T.StructField("visit_count", T.IntegerType()),
])

# They decide results and must not be tuned.
K1, B = 1.2, 0.75
HEAD = 500  # pages ranked exactly
POSITIONS = 32  # kept for a term in a page
TERM_CHARS = 64
BUCKET_BITS = 8
PREFIX_CHARS, PREFIX_SCAN, PREFIX_LIMIT, WIDENED = 3, 200, 24, 0.75
TYPO_CHARS, TYPO_SCAN, TYPO_PREFIX, TYPO_LONG = 4, 60, 3, 6
TITLE_BOOST, PINNED_BOOST, RECENCY = 0.08, 1.05, 0.15
FACETS, PAGE = 8, 20
TEXT_BYTES, EXCERPT, TITLE_CHARS = 200 * 1024, 400, 1000
MIN_TEXT, OVER_TITLE = 25, 20
SHRINK_CHARS, SHRINK_SHARE = 1000, 0.4
MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000
MONTH_MS = 365.25 / 12 * DAY_MS
RETENTION_MONTHS, SIZE_CAP, WARN_AT = 12, 500 * 1024 * 1024, 0.8
DWELL_MS, SCROLL, SHORT_WORDS = 9000, 0.35, 400
LOG_GAP_MS, LOG_ROWS = 600_000, 500
CLOCK_JUMP_MS, CLOCK_BACK_MS, CLOCK_HOLD_MS = 7 * DAY_MS, 3_600_000, DAY_MS
PAGE_BYTES, ENTRY_BYTES, POSITION_BYTES, RECORD_BYTES, TERM_BYTES = 130, 25, 4, 34, 2
PAGE_BYTES_ESTIMATE = 15 * 1024
OMNIBOX, LOG_READ = 6, 20
TICK_MS, TICK_SLACK_MS, OFFER_FLOOR_MS, OFFER_GAP_MS, SCROLL_STEP = 2500, 500, 5000, 60_000, 0.05
EXPORT_FORMAT = "page-archive-export"
