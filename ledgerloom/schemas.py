"""Explicit schemas of stored tables. Built without a session, so modules import anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
REAL, FLAG, TIME = T.DoubleType(), T.BooleanType(), T.TimestampType()
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRACE_SCHEMA = struct(
    ts=TIME, run_id=TEXT, seq=LONG, event=TEXT, agent=TEXT, tool=TEXT, args=TEXT, why=TEXT, status=TEXT,
    output=TEXT, output_chars=LONG, duration_ms=REAL, cache_hit=FLAG, turn=LONG, model=TEXT, tool_calls=TEXTS,
    text=TEXT, tokens=LONG, sender=TEXT, receiver=TEXT, schema=TEXT, step=TEXT, content=TEXT, generated_by=TEXT,
    risks=TEXTS, hedge=TEXT, action=TEXT, path=TEXT, reason=TEXT, warnings=TEXTS,
)
CALL_LOG_SCHEMA = struct(
    ts=TIME, profile=TEXT, prompt=TEXT, prompt_version=TEXT, schema=TEXT, provider=TEXT, model=TEXT, outcome=TEXT,
    attempts=LONG, sdk_retries=LONG, latency_ms=REAL, prompt_tokens=LONG, completion_tokens=LONG, errors=TEXTS,
    raw_excerpt=TEXT, choice=TEXT, probabilities=T.MapType(TEXT, REAL),
)
FUNCTION_SCHEMA = struct(id=TEXT, topic=TEXT, kind=TEXT, level=TEXT, code=TEXT)
LABEL_SCHEMA = struct(id=TEXT, docstring=TEXT, label=TEXT, missing=TEXTS, invented=TEXTS)
CHAT_SCHEMA = struct(
    id=TEXT, topic=TEXT, kind=TEXT, level=TEXT, messages=T.ArrayType(struct(role=TEXT, content=TEXT))
)
CODE_FACTS = struct(
    name=TEXT, params=TEXTS, first_arg=TEXT, is_async=FLAG, is_generator=FLAG, returns_value=FLAG, raises=TEXTS,
    has_docstring=FLAG, code_lines=INT, modules=TEXTS, error=TEXT,
)
_RSS_ITEMS = T.ArrayType(struct(title=TEXT, pubDate=TEXT, link=TEXT, source=struct(_VALUE=TEXT, _url=TEXT)))
#: Items are children of the channel or, in RSS 1.0, of the root beside it.
RSS_SCHEMA = struct(channel=struct(item=_RSS_ITEMS), item=_RSS_ITEMS)
