"""Constants of the engine; values that rankings and gates depend on."""

from __future__ import annotations

#: Rank fusion, class prior, candidate and search limits.
RRF_K = 60
PRIOR_WEIGHT = 0.05
CANDIDATES = 100
CANDIDATE_FACTOR = 20
SEARCH_LIMIT, SEARCH_LIMIT_MOST, QUERY_CHARS_MOST, QUESTION_LIMIT = 5, 20, 4000, 4
#: Sections in words.
MAX_SECTION_WORDS, MIN_CHUNK_WORDS, OVERLAP_WORDS, MIN_SECTION_WORDS = 350, 250, 50, 20
#: References, headings, passages and sources in characters.
REF_CHARS, HEADING_CHARS, PASSAGE_CHARS, SOURCE_CHARS, MIN_QUOTE_CHARS = 120, 240, 240, 1500, 20
#: Gates.
PARSE_FAILURE_LIMIT, PSI_THRESHOLD, PSI_FLOOR = 0.05, 0.25, 1e-6
#: Deliveries and leases in seconds.
BACKOFF_MOST, LEASE_SECONDS, MAX_ATTEMPTS = 300, 60, 3
#: Digits to which scores are rounded before they are ranked, so that equal sums tie.
SCORE_DIGITS = 9
