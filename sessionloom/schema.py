"""The normalized event table ``ev``: one row per prompt, usage record, tool call, tool result, edit or marker.

``seq`` is unique and increasing within ``file_id``; ``ts`` is a UTC wall-clock timestamp without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# kind -> meaning
KINDS = {
    "prompt": "instruction typed by a person (text is dropped before any sink)",
    "turn": "turn context of a B log",
    "tokens": "one usage record",
    "tool_call": "one tool invocation",
    "tool_result": "one tool outcome",
    "edit": "one file change with line counts",
    "interrupt": "a tool run stopped by the person",
    "api_error": "a failed request",
    "compaction": "context compaction",
    "abort": "a turn given up",
    "attachment": "an attached file",
    "subagent": "a record written by a sub-agent",
    "touch": "a person-side record without prompt or result",
    "label": "one enumerated label (label_field, label)",
}

# Positions of ``ev``: seq = line * STRIDE + slot; slots leave room for many facts per line.
STRIDE = 1 << 20

EV_FIELDS = [
    ("platform", "string"), ("file_id", "string"), ("seq", "bigint"), ("ts", "timestamp_ntz"),
    ("session_id", "string"), ("repo", "string"), ("branch", "string"), ("is_sidechain", "boolean"),
    ("kind", "string"), ("is_boundary", "boolean"), ("source", "string"),
    ("model", "string"), ("input", "bigint"), ("cached_input", "bigint"), ("output", "bigint"),
    ("reasoning_output", "bigint"), ("cache_creation", "bigint"), ("total", "bigint"),
    ("tool_name", "string"), ("tool_kind", "string"), ("command", "string"), ("file_base", "string"),
    ("file_ext", "string"), ("is_edit", "boolean"), ("long_run", "boolean"),
    ("is_error", "boolean"), ("error_category", "string"),
    ("lines_added", "bigint"), ("lines_removed", "bigint"), ("user_modified", "boolean"),
    ("prompt_text", "string"), ("is_correction", "boolean"), ("is_thinking", "boolean"),
    ("label_field", "string"), ("label", "string"), ("value", "bigint"),
    ("web_search_requests", "bigint"), ("web_fetch_requests", "bigint"),
]

TOKEN_BUCKETS = ["input", "cached_input", "output", "reasoning_output", "cache_creation", "total"]

# Columns that may hold free text; no result table has one of these names.
TEXT_COLUMNS = {"prompt_text", "command", "text", "raw", "value_text"}


def as_ev(df: DataFrame) -> DataFrame:
    """Project to the ``ev`` contract; missing columns become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(dtype).alias(name) for name, dtype in EV_FIELDS
    ])
