"""Distribution divergence rules (operator 9), on DataFrame functions alone.

A document is compared to its language's reference by the Jensen-Shannon distance (base 2, 0 to 1) of two histograms:
character classes, and the common words of the language with all other words as one more class. References are the
summed histograms of all documents of a language. Documents under a minimum length are not judged by divergence.

Defined results: null and empty texts have no words and fail the base rule; a null or unknown language is compared by
the character classes of all documents together and not by words. Rows are judged one by one, so repeated ids and
ties keep a row each. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from histlake.llm.common import let, table, words, written

#: The commonest function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 50, 0.25, 0.3
#: Character classes by a pattern of what is not in them; "other" is the rest.
CLASSES = {"lower": r"\P{Ll}+", "upper": r"\P{Lu}+", "digit": r"[^0-9]+", "symbol": r"[^#*$%&|<>+=~^@\\/_{}\[\]]+", "mark": r"[^.,;:!?'\"()-]+", "gap": r"[^\x20\x09-\x0D]+"}
N_CLASSES, N_WORDS = len(CLASSES) + 1, 11


def windows(ws: Column) -> Column:
    """A hash of each run of five words."""
    return let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(5)]).alias("h"), i.alias("i")),
        ),
    )


def repeated_words(ws: Column) -> Column:
    """Words in five-word windows found twice or more: sort the windows, keep those like a neighbour, add up what
    their starts cover."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        return F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce((i < last) & same(i, i + 1), F.lit(False))).alias("on"))),
                    lambda x: x["on"],
                ),
                lambda x: x["i"],
            )
        )

    def cover(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(5)), F.lit(5))), F.lit(0).cast("long"), lambda a, x: a + x
        )

    return let(let(F.array_sort(windows(ws)), starts), cover)


def char_counts(text: Column) -> list[Column]:
    counts = [F.length(F.regexp_replace(text, p, "")) for p in CLASSES.values()]
    return [*counts, F.length(text) - reduce(lambda a, b: a + b, counts)]


def word_counts(ws: Column, lang: Column) -> Column:
    """How often each common word of the language stands, then all other words; an empty array without a language."""
    count = lambda c, k: F.size(F.filter(c, lambda w: w == k)).cast("long")
    tally = lambda common: lambda c: F.concat(F.array(*[count(c, k) for k in common]), F.array((F.size(ws) - F.size(c)).cast("long")))
    out = F.array().cast("array<bigint>")
    for code, common in COMMON.items():
        body = let(F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.isin(COMMON[code])), tally(common))
        out = F.when(lang == code, body).otherwise(out)
    return out


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of counts of one length, each divided by its sum."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    both = lambda v: F.aggregate(
        F.zip_with(p, q, lambda x, y: part(x / v["a"], y / v["b"]) + part(y / v["b"], x / v["a"])), F.lit(0.0), lambda s, x: s + x
    )
    return let(F.struct(total(p).alias("a"), total(q).alias("b")), lambda v: F.sqrt(F.greatest(F.lit(0.0), both(v) / 2)))


def histograms(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, and both histograms. One pass over whole texts."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("").alias("lang"), text.alias("text"))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_word = let(
        words(F.col("text")),
        lambda ws: F.struct(long(F.size(ws)).alias("n_words"), repeated_words(ws).alias("n_repeat_words"), word_counts(ws, F.col("lang")).alias("word_hist")),
    )
    return docs.select(
        "doc_id", "lang", F.array(*map(long, char_counts(F.col("text")))).alias("char_hist"), by_word.alias("w"),
        long(F.length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
    ).select("*", "w.*").drop("w")


def references(hists: DataFrame) -> DataFrame:
    """Summed histograms of each language and, as language "*", of all documents; a few rows whatever the input."""
    sums = lambda c, n, p: [F.sum(F.get(c, F.lit(i))).alias(f"{p}{i}") for i in range(n)]
    by = hists.groupBy("lang").agg(*sums("char_hist", N_CLASSES, "c"), *sums("word_hist", N_WORDS, "w"))
    of = lambda p, n: F.array(*[F.coalesce(F.sum(f"{p}{i}"), F.lit(0)) for i in range(n)])
    return by.groupBy("lang").agg(of("c", N_CLASSES).alias("ref_chars"), of("w", N_WORDS).alias("ref_words")).unionByName(
        by.agg(of("c", N_CLASSES).alias("ref_chars"), F.array().cast("array<bigint>").alias("ref_words")).withColumn("lang", F.lit("*"))
    )


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per row: the counts, both distances (null under the minimum length), base_failed, kept and the failed rule."""
    hists = written(histograms(docs), "rule-histograms")
    ref = F.broadcast(references(hists))
    key = F.when(F.col("lang") == "", "*").otherwise(F.col("lang"))
    out = hists.withColumn("lang", key).join(ref, "lang", "left")
    guarded = F.col("n_words") >= min_words
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.round(F.when(guarded, jensen_shannon(F.col("char_hist"), F.col("ref_chars"))), 6).alias("char_distance"),
        F.round(F.when(guarded & (F.size("word_hist") > 0), jensen_shannon(F.col("word_hist"), F.col("ref_words"))), 6).alias("word_distance"),
    )
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same verdicts for a reference engine."""
    gap = r"[\x20\x09-\x0D]+"
    chars = [f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in CLASSES.values()]
    word_lists = " ".join(f"WHEN '{c}' THEN {common}" for c, common in COMMON.items())
    part = "CASE WHEN z[{0}] > 0 THEN z[{0}] / {2} * log2(2 * (z[{0}] / {2}) / (z[{0}] / {2} + z[{1}] / {3})) ELSE 0 END"
    js = lambda p, q: f"(SELECT sqrt(greatest(0, list_sum(list_transform(list_zip(CAST({p} AS DOUBLE[]), CAST({q} AS DOUBLE[])), lambda z: {part.format(1, 2, f'list_sum({p})', f'list_sum({q})')} + {part.format(2, 1, f'list_sum({q})', f'list_sum({p})')})) / 2)))"
    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i}]), 0)" for i in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{c}'" for c in COMMON)}) THEN lang ELSE '*' END AS lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS ws, CASE lang {word_lists} ELSE [] END AS common FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS s FROM w WHERE len(ws) >= 5)),
v AS (SELECT r, sum(least(5, coalesce(lead_i - i, 5))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM g WHERE c > 1) GROUP BY r),
h AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '{gap}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  [{", ".join(chars)}, length(t) - ({" + ".join(chars)})] AS cs,
  CASE WHEN len(common) > 0 THEN list_append(list_transform(common, lambda k: len(list_filter(ws, lambda x: lower(x) = k))), len(list_filter(ws, lambda x: NOT list_contains(common, lower(x))))) ELSE [] END AS wh
  FROM w LEFT JOIN v USING (r)),
f AS (SELECT lang, {sums("cs", N_CLASSES)} AS rc, {sums("wh", N_WORDS)} AS rw FROM h WHERE lang <> '*' GROUP BY lang UNION ALL SELECT '*', {sums("cs", N_CLASSES)}, [] FROM h),
j AS (SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words >= {MIN_WORDS} THEN round({js("cs", "rc")}, 6) END AS char_distance,
  CASE WHEN n_words >= {MIN_WORDS} AND len(wh) > 0 THEN round({js("wh", "rw")}, 6) END AS word_distance FROM h JOIN f USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  n_repeat_words, base_failed, char_distance, word_distance, NOT base_failed AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept FROM j
"""


SQL = _sql()
