"""Explicit schemas of the records; nothing is inferred."""

MESSAGE = "STRUCT<role: STRING, content: STRING>"
RECORD = (
    "id STRING, split STRING, category STRING, topic STRING, core_question STRING, answer_summary STRING, "
    "expected_answers ARRAY<STRING>, persona STRING"
)
CONVERSATION = f"{RECORD}, regens INT, status STRING, drop_reason STRING, messages ARRAY<{MESSAGE}>"
BLUEPRINT = f"{RECORD}, turns ARRAY<STRING>"
RAW = f"id STRING, turns ARRAY<STRING>, messages ARRAY<{MESSAGE}>"
TICKET = "id STRING, attempts INT, raw_sha STRING, failed_turns ARRAY<STRUCT<turn: INT, reason: STRING>>"
TOPIC = "topic STRING, core_question STRING, answer STRING, expected_answers ARRAY<STRING>, answer_summary STRING, category STRING"
VERDICT_CACHE = "key STRING, leak BOOLEAN, reason STRING"
TRANSCRIPT = (
    "model STRING, model_slug STRING, strategy STRING, scenario_id STRING, category STRING, core_question STRING, "
    "answer_summary STRING, expected_answers ARRAY<STRING>, turns_hash STRING, "
    "exchanges ARRAY<STRUCT<user: STRING, assistant: STRING, finish_reason: STRING>>"
)
CORRUPT = "_corrupt_record"
