"""History files of shells as entries. Files are read by Spark, each as one row, and cut up natively."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from histlake.schema import ENTRY, conform

#: The shapes of stamped lines.
ZSH_STAMPED, ZSH_TRIED, BASH_STAMP = r"(?s)^:\s+(\d+):(\d+);(.*)$", r"^:\s", r"^#(\d{9,})$"
#: Stands for a line end that a backslash continues.
JOINT = ""


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Strict UTF-8, else the whole file as Latin-1; line ends become \\n."""

    def one(data: bytes) -> str:
        try:
            text = bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            text = bytes(data).decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    return content.map(one, na_action="ignore")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file; none if path matches nothing."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], "path string, content binary")
    return found.select("path", decoded("content").alias("text"))


def newer(ts: Column, since: int | None) -> Column:
    """Entries after the cursor; unknown times always pass."""
    return (ts == 0) | (ts > (since or 0))


def continued(text: Column) -> Column:
    """Logical lines: a trailing backslash goes and its line goes on, with the line end; a last one stays. Empty lines
    are none."""
    joined = F.replace(text, F.lit("\\\n"), F.lit(JOINT))
    return F.filter(F.transform(F.split(joined, "\n"), lambda x: F.replace(x, F.lit(JOINT), F.lit("\n"))), lambda x: x != "")


def read_zsh(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Stamped lines have time and duration, others time 0; lines that only begin like stamped ones are left out."""
    lines = files(spark, path).select("path", F.posexplode(continued(F.col("text"))).alias("ordinal", "line"))
    part = lambda i: F.regexp_extract("line", ZSH_STAMPED, i)
    stamped = F.col("line").rlike(ZSH_STAMPED)
    out = lines.filter(stamped | ~F.col("line").rlike(ZSH_TRIED)).select(
        F.when(stamped, part(3)).otherwise(F.col("line")).alias("text"),
        F.when(stamped, part(1).cast("long")).otherwise(F.lit(0)).alias("ts"),
        F.when(stamped, part(2).cast("long") * 1000).alias("duration_ms"),
        F.lit("zsh").alias("source"), F.col("ordinal").cast("long"),
    )
    return conform(out.filter(newer(F.col("ts"), since)), ENTRY)


def read_bash(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """A stamp line dates the next line alone; of stamps in a row the last counts."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    stamp = lambda x: F.regexp_extract(x, BASH_STAMP, 1)
    # The line before is looked up in the file's own array, so no file is sorted or dealt anew.
    pairs = F.transform(F.col("lines"), lambda x, i: F.struct(x.alias("line"), F.when(i > 0, stamp(F.get(F.col("lines"), i - 1))).alias("before")))
    rows = files(spark, path).select(lines.alias("lines")).select(F.posexplode(pairs).alias("ordinal", "p")).filter(stamp(F.col("p.line")) == "")
    ts = F.when(F.col("p.before") != "", F.col("p.before").cast("long")).otherwise(F.lit(0))
    out = rows.select(F.col("p.line").alias("text"), ts.alias("ts"), F.lit("bash").alias("source"), F.col("ordinal").cast("long"))
    return conform(out.filter(newer(F.col("ts"), since)), ENTRY)
