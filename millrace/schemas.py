"""Table schemas of the catalogue."""

from __future__ import annotations

RECORD_FIELDS = """name string, description string, meeting_schedule string, location string, contact string, website string,
social_links array<string>, confidence double, joinable boolean, founding_year int, member_count string, fee string,
age_range string, skill_level string, join_process string, leader string, email string, phone string, tags array<string>, language string"""
RECORD = f"""{RECORD_FIELDS}, topic string, city string, locale string, source_url string, source_urls array<string>,
extracted_at string, community_id string"""

CITIES = "name string, country string, locale string, search_variants array<string>"
TOPICS = "name string, search_terms map<string, array<string>>"
SEARCH_RESULTS = "city string, topic string, query_no int, rank int, url string, title string, snippet string"
RAW_PAGES = "url string, status int, content_type string, html string"
CACHE_PAGES = f"""url_hash string, url string, domain string, city string, topic string, scraped_at timestamp, raw_text string,
scrape_duration_s double, source_queries array<string>, extracted_at timestamp, extract_fingerprint string, extract_model string,
extract_duration_s double, records array<struct<{RECORD}>>, enrich_count int"""
COMMUNITIES = f"record_key string, {RECORD}, updated_at timestamp"
FALSE_POSITIVES = "name string, city string, topic string, reason string, source_url string, fp_type string, marked_at timestamp"
PROMPT_HISTORY = "version int, timestamp timestamp, content string, fp_type string, fp_count int"
RUNS = """id long, started_at timestamp, finished_at timestamp, run_mode string, success boolean,
pairs array<struct<city string, topic string, queries array<string>, urls_found int, fetched_urls array<string>, fetch_failed int,
cache_hits_scrape int, cache_hits_extract int, records_extracted int>>"""
SUBSCRIPTIONS = "id long, email string, city string, topic string, token string, created_at timestamp"
LOG_LINES = "seq long, ts string, level string, text string"
