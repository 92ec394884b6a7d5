"""Table schemas and the numeric constants of the data model."""

from __future__ import annotations

# Fixed values of the data model: sizes, thresholds and defaults.
EMBED_DIMS = 768
PARENT_TOKENS = 800
CHILD_TOKENS = 256
OVERLAP_TOKENS = 50
EMBED_BATCH = 100
RRF_K = 60
TOP_K = 5
OVER_FETCH = 2
PRETTY_PREVIEW = 300
NOTES_PREVIEW = 500
QUERY_SLUG_CHARS = 60
LONG_BOOK_CHARS = 100_000
CHAPTER_MIN_BODY = 200
NATIVE_CHARS_PER_PAGE = 100
SAMPLE_PAGES = 5
QUALITY_CHARS_PER_PAGE = 500
LOCAL_PAGE_BATCH = 50
CLOUD_PAGE_BATCH = 100
FUZZY_THRESHOLD = 0.7
FUZZY_SAMPLE_CHARS = 20_000
MAX_FILES_PER_TRIGGER = 100
POLL_SECONDS = 2
INPUT_PRICE_PER_MTOK = 0.10
OUTPUT_PRICE_PER_MTOK = 0.20
OCR_PRICE_PER_1K_PAGES = 1.0

BM25_K1 = 1.2
BM25_B = 0.75


PARENTS_DDL = (
    "id string, book_id string, author string, title string, chapter_number int, "
    "chapter_title string, parent_index int, char_start bigint, char_end bigint, text string"
)
CHILDREN_DDL = (
    "id string, parent_id string, book_id string, author string, chunk_index int, "
    "text string, context_text string, vector array<float>"
)
CHAPTER_MAP_DDL = (
    "struct<number:int,title:string,summary:string,"
    "key_arguments:array<string>,themes:array<string>>"
)
BOOK_MAP_DDL = (
    "id string, author string, title string, year int, source_epub string, source_md string, "
    f"summary string, key_themes array<string>, chapters array<{CHAPTER_MAP_DDL}>"
)
META_DDL = (
    "sha256 string, original_name string, file_type string, classification string, staging_category string, "
    "probe struct<avg_chars_per_page:double,sampled_pages:int,total_pages:int,classification:string>, "
    "raw_chars int, page_count int, chars_per_page double, conversion_method string, conversion_error string, "
    "reclassified_to string, reclassified_from string, quality_gate string, clean_chars int, quality_score double, "
    "cleanup_method string, book_id string, md_path string, rag_map_generated boolean, rag_indexed boolean, "
    "fanout_kindle boolean, fanout_rag boolean, fanout_archive boolean, batch_id string, batch_status string, "
    "batch_error string, created_at timestamp, updated_at timestamp"
)
OCR_BATCH_DDL = (
    "batch_id string, request_file_id string, books bigint, "
    "total_pages bigint, cost_estimate double, status string"
)
OCR_RESULT_DDL = (
    "custom_id string, response struct<body:struct<pages:array<struct<index:int,markdown:string>>>>"
)
