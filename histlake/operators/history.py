"""Queries over stored commands: filters, listings, statistics and sequences. All are lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from histlake.functions.texts import contains_literal, under_path

FOLLOWING = 3
#: Rows that matches of one request can be at most, and so may be broadcast.
MOST_MATCHES = 200


def scoped(commands: DataFrame, cwd_prefix: str | None = None, host: str | None = None, since: int | None = None) -> DataFrame:
    """Keeps commands at or below a path, of a host, and not before a time."""
    if cwd_prefix is not None:
        commands = commands.filter(under_path(F.col("cwd"), cwd_prefix))
    if host is not None:
        commands = commands.filter(F.col("hostname") == host)
    return commands if since is None else commands.filter(F.col("ts") >= since)


def recent(commands: DataFrame, limit: int, cwd_prefix: str | None = None, host: str | None = None) -> DataFrame:
    """Known times first, latest first; then the latest inserted."""
    known = F.when(F.col("ts") > 0, 0).otherwise(1)
    return scoped(commands, cwd_prefix, host).orderBy(known, F.desc("ts"), F.desc("id")).limit(limit)


def matching(commands: DataFrame, pattern: str) -> DataFrame:
    return commands.filter(contains_literal(F.col("text_scrubbed"), pattern))


def failed(commands: DataFrame, cutoff: int, pattern: str | None = None) -> DataFrame:
    """Commands that ended with an error since a time; only one source knows how commands end."""
    out = commands.filter((F.col("source") == "atuin") & (F.col("exit_code") != 0) & (F.col("ts") >= cutoff))
    return out if pattern is None else matching(out, pattern)


def failed_recently(commands: DataFrame, cutoff: int, limit: int, pattern: str | None = None) -> DataFrame:
    return failed(commands, cutoff, pattern).orderBy(F.desc("ts"), "id").limit(limit)


def has_source(commands: DataFrame, source: str) -> bool:
    return not commands.filter(F.col("source") == source).limit(1).isEmpty()


def totals(matches: DataFrame) -> DataFrame:
    """total, mean_duration_ms and success_rate: one row, in one pass."""
    known, good = F.count("exit_code"), F.count(F.when(F.col("exit_code") == 0, 1))
    return matches.agg(F.count("*").alias("total"), F.avg("duration_ms").alias("mean_duration_ms"), F.try_divide(good, known).alias("success_rate"))


def top_paths(matches: DataFrame, limit: int = 5) -> DataFrame:
    return matches.filter("cwd is not null").groupBy("cwd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwd").limit(limit)


def by_source(matches: DataFrame) -> DataFrame:
    return matches.groupBy("source").agg(F.count("*").alias("n"))


def stats(matches: DataFrame) -> DataFrame:
    """One row: totals, top_cwds as an array of structs and by_source as a map. One scan counts by (source, path);
    its few rows give all three parts."""
    cells = matches.groupBy("source", "cwd").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("timed"),
        F.count("exit_code").alias("ended"), F.count(F.when(F.col("exit_code") == 0, 1)).alias("good"),
    )
    one = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.try_divide(F.sum("ms"), F.sum("timed")).alias("mean_duration_ms"),
        F.try_divide(F.sum("good"), F.sum("ended")).alias("success_rate"),
    )
    paths = cells.filter("cwd is not null").groupBy("cwd").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cwd").limit(5)
    paths = paths.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cwd"))).alias("p"))
    paths = paths.select(F.transform("p", lambda x: F.struct(x["cwd"].alias("cwd"), (-x["m"]).alias("n"))).alias("top_cwds"))
    sources = cells.groupBy("source").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return one.join(paths).join(sources)  # one row each


def later(m: str, c: str) -> Column:
    """Whether c stands after m in time, by id where times are equal."""
    return (F.col(f"{c}.ts") > F.col(f"{m}.ts")) | ((F.col(f"{c}.ts") == F.col(f"{m}.ts")) & (F.col(f"{c}.id") > F.col(f"{m}.id")))


def following(matches: DataFrame, commands: DataFrame, n: int = FOLLOWING) -> DataFrame:
    """match_id, pos and the columns of the n next commands in the session of each match. matches are of one request,
    so few enough to broadcast; a partial top n comes before the shuffle."""
    m = F.broadcast(matches.select("id", "ts", "session_id").limit(MOST_MATCHES)).alias("m")
    pairs = commands.alias("c").join(m, (F.col("c.session_id") == F.col("m.session_id")) & later("m", "c"))
    w = W.partitionBy("match_id").orderBy("ts", "id")
    out = pairs.select(F.col("m.id").alias("match_id"), "c.*").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
    return out.select("match_id", "pos", *commands.columns)


def following_all(commands: DataFrame, key: str, order: tuple[str, ...], n: int = FOLLOWING) -> DataFrame:
    """The same for every row at once: each row's next n in its key, by offsets, so nothing is joined."""
    w = W.partitionBy(key).orderBy(*order)
    nexts = F.array(*[F.struct(F.lit(i).alias("pos"), F.lead(F.struct(*order), i).over(w).alias("next")) for i in range(1, n + 1)])
    return commands.withColumn("nexts", F.filter(nexts, lambda x: x["next"].isNotNull()))


def after(commands: DataFrame, pattern: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The latest matches, and what followed each."""
    matches = matching(commands, pattern).orderBy(F.desc("ts"), "id").limit(limit)
    return matches, following(matches, commands)
