"""Schemas of the persistent tables, as DDL."""

CHUNKS = "path STRING, line_start INT, line_end INT, content STRING, fts_text STRING, description STRING, embedding ARRAY<FLOAT>, content_hash STRING"
TRACES = "trace_id STRING, question_hash STRING, question STRING, summary STRING, component_kinds ARRAY<STRING>, ts TIMESTAMP, embedding ARRAY<FLOAT>"
CODE_GRAPH = "path STRING, line_start INT, line_end INT, kind STRING, name STRING, target STRING, detail STRING, syntax STRUCT<engine: STRING, grammar: STRING, family: STRING, node_type: STRING, query: STRING>, content_hash STRING"
FILES = "path STRING, content STRING, size_bytes LONG, is_binary BOOLEAN"
EVENTS = "trace_id STRING, seq LONG, type STRING, id STRING, idx INT, payload STRING"
