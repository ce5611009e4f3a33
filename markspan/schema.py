"""Schemas of nested values, as DDL text."""

TEXT_MAP = "MAP<STRING,STRING>"

# Shape of the list-form result documents that older runs stored.
LEGACY_DOCUMENT = (
    "multiple_choice ARRAY<STRUCT<question: BIGINT, answer: STRING>>, "
    "free_response ARRAY<STRUCT<question: BIGINT, response: STRING>>"
)
# A layout's format description as a model returns it; ranges come as text or as an object, so they stay text here.
FORMAT_RESPONSE = (
    "header_fields ARRAY<STRUCT<key: STRING, label: STRING>>, mcq_range STRING, numeric_range STRING, "
    "drawing_range STRING, answer_options ARRAY<STRING>, total_questions BIGINT, description STRING"
)
