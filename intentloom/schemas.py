"""Record shapes of the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ITEMS = T.StructType([*_strings("source", "url", "title", "text", "published", "author"), T.StructField("query_idx", T.IntegerType()), T.StructField("pos", T.IntegerType())])
QUERY_SPECS = T.StructType([T.StructField("query_idx", T.IntegerType()), T.StructField("query", T.StringType()), T.StructField("domains", T.ArrayType(T.StringType()))])
SENDER = T.StructType(_strings("username", "first_name", "last_name"))
MESSAGES = T.StructType([T.StructField("group_id", T.LongType()), T.StructField("message_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("date", T.TimestampType()), T.StructField("sender", SENDER)])
GROUPS = T.StructType([T.StructField("group_id", T.LongType()), *_strings("name", "username"), T.StructField("is_group", T.BooleanType())])
LEDGER = T.StructType([T.StructField("lead_id", T.StringType()), T.StructField("found_at", T.TimestampType()), T.StructField("run_id", T.StringType())])
