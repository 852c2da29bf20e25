"""Schemas of the tables that are kept, and of the inputs that need one."""

from __future__ import annotations

SCHEMA_VERSION = 3
PRIOR_SCHEMA_VERSION = 2

META = "key STRING, value STRING"
SENTENCES = "id LONG, zh_text STRING, tokens_word ARRAY<STRING>, tokens_hsk ARRAY<STRING>, tokens_char ARRAY<STRING>, patterns ARRAY<STRING>, skeleton STRING, source STRING, created_at TIMESTAMP"
VOCAB_STATS = "word STRING, count LONG, mastery DOUBLE, last_seen TIMESTAMP, hsk_level INT, hsk_frequency INT"
PATTERN_PERSONAL_STATS = "pattern_key STRING, family STRING, count_seen LONG, distinct_sentence_count LONG, emerged BOOLEAN, last_seen_at TIMESTAMP"
PATTERN_PERSONAL_REALIZATIONS = "pattern_key STRING, realization STRING"
RUNS = "id LONG, kind STRING, created_at TIMESTAMP, config_hash STRING, anchors_hash STRING, notes STRING"
PATTERN_GLOBAL_STATS = "pattern_key STRING, family STRING, count_sentences LONG, count_occurrences LONG, distinct_realization_count LONG, p_global DOUBLE"
PATTERN_GLOBAL_REALIZATIONS = "pattern_key STRING, realization STRING"
LEXICON = "simplified STRING, level INT, frequency INT, pinyin STRING, meanings STRING, pos STRING, traditional STRING"

STATE_TABLES = {
    "meta": META,
    "sentences": SENTENCES,
    "vocab_stats": VOCAB_STATS,
    "pattern_personal_stats": PATTERN_PERSONAL_STATS,
    "pattern_personal_realizations": PATTERN_PERSONAL_REALIZATIONS,
    "runs": RUNS,
}
PRIOR_TABLES = {"meta": META, "pattern_global_stats": PATTERN_GLOBAL_STATS, "pattern_global_realizations": PATTERN_GLOBAL_REALIZATIONS}

FLASH_CARDS = "front STRING, back STRING"
DICTIONARY_JSON = (
    "simplified STRING, level ARRAY<STRING>, frequency STRING, pos ARRAY<STRING>, "
    "forms ARRAY<STRUCT<traditional: STRING, transcriptions: STRUCT<pinyin: STRING>, meanings: ARRAY<STRING>>>"
)

#: Older names of columns, which readers accept.
LEGACY_COLUMNS = {"pattern_id": "pattern_key", "count": "count_sentences", "diversity": "distinct_realization_count"}
