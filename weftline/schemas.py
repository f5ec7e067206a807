"""Declared schemas of the record kinds, as DDL; readers use them instead of inference."""

#: An utterance within a talk's record.
UTTERANCE = "sequence_index INT, start_time STRING, start_seconds INT, text STRING, source_line INT, source_label STRING"

TALK = (
    "schema_version STRING, event_id STRING, event_title STRING, event_date STRING, talk_id STRING, talk_index INT, title STRING, primary_speaker STRING, speakers ARRAY<STRING>,"
    "languages ARRAY<STRING>, start_time STRING, end_time STRING, start_seconds INT, end_seconds INT, utterance_count INT, text STRING, content_sha256 STRING, source_file STRING,"
    f"utterances ARRAY<STRUCT<{UTTERANCE}>>"
)

#: What the chunker makes.
CHUNK = (
    "talk_id STRING, chunk_id STRING, chunk_index INT, start_sequence_index INT, end_sequence_index INT, new_start_sequence_index INT, new_end_sequence_index INT, utterance_count INT,"
    "new_utterance_count INT, token_count INT, new_token_count INT, overlap_token_count INT, reason STRING, tokens_before INT, tokens_after INT, distance_before INT, distance_after INT"
)

#: A chunk with its text and rows, as it is written, indexed and checked.
CHUNK_RECORD = (
    "chunk_id STRING, event_id STRING, talk_id STRING, title STRING, primary_speaker STRING, chunk_index INT, start_sequence_index INT, end_sequence_index INT, new_start_sequence_index INT,"
    "new_end_sequence_index INT, start_source_line INT, end_source_line INT, start_time STRING, end_time STRING, utterance_count INT, new_utterance_count INT, token_count INT,"
    "new_content_token_count INT, overlap_with_previous STRUCT<previous_chunk_id: STRING, utterance_count: INT, token_count: INT, start_sequence_index: INT, end_sequence_index: INT>,"
    "closure STRUCT<reason: STRING, candidate_sequence_index: INT, tokens_before: INT, tokens_after: INT, distance_before: INT, distance_after: INT>, content_sha256 STRING, text STRING,"
    "utterances ARRAY<STRUCT<sequence_index: INT, source_line: INT, start_time: STRING, start_seconds: INT, source_label: STRING, text: STRING, is_overlap: BOOLEAN>>"
)
