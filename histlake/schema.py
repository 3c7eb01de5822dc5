"""Schemas of the history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SCHEMA_VERSION = 1
VECTOR_SIZE = 384

#: What every source yields; ts 0 is unknown, ordinal is the place in the source.
ENTRY = T.StructType(
    [
        T.StructField("text", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_id", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ordinal", T.LongType()),
    ]
)

COMMANDS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("text_scrubbed", T.StringType()),
        T.StructField("text_hash", T.BinaryType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
)

#: Vectors stand apart from rows, so that only searches read them.
VECTORS = T.StructType([T.StructField("command_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

#: The inverted index: how often each command has each term.
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.LongType()), T.StructField("tf", T.LongType())])

HIT = ("id", "text", "text_hash", "source", "ts", "cwd", "hostname", "exit_code", "duration_ms", "session_id")


def conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """df with exactly the schema's columns: absent optional ones are null, absent required ones an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing required columns: {sorted(missing)}; found: {sorted(df.columns)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
