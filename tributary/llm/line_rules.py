"""Quality rules, line first: rules judge single lines, failing lines go, and a document that loses too much text goes with them.

All of it is native column work on one row at a time: no shuffle, no Python. Word windows are compared by a 64-bit hash inside one text.

Defined results: null text counts as empty; an empty text has no words and fails the base rules; rows repeated in the input are judged
one by one; further columns of the input pass through ``clean`` untouched unless named like one of the result columns, which win. An empty table
gives an empty one. Texts may be of any length; a text is judged in its own row, at the cost of its words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: What a line of prose may end with, spaces after it aside; a line cut inside a sentence passes if an earlier sentence ends in it.
TERMINAL = tuple(".!?…:;,\"'”’»)]。！？")
ENDED = (". ", "! ", "? ", "。", "！", "？")
#: Menus and breadcrumbs: several separators between short entries, or nothing but usual menu entries.
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(?:(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|sitemap|share|print)[\x20\x09-\x0D>|/]*)+$"
SEPARATOR = r"[\x20\x09-\x0D][|»›>](?=[\x20\x09-\x0D]|$)"
BOILERPLATE = (
    "cookie policy", "cookie settings", "use cookies", "uses cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "javascript is disabled", "javascript is required", "lorem ipsum", "click here",
    "subscribe to our", "sign up for our", "powered by",
)
#: A word that ends in a run of the same mark, as shouting and mark-up debris do.
NOISE = r"(?:([#*$%&|<>!])\1+)(?=[\x20\x09-\x0D]|$)"

MIN_WORDS, MAX_REPEATED, MAX_LOST, MAX_NOISE, MIN_SEPARATORS = 50, 50, 50, 30, 2
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "clean_text")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, low: Column, words: Column) -> Column:
    """Whether a line (``low``: in lower case) of ``words`` words goes: menu, boilerplate, mark noise, or prose that ends nowhere."""
    any_of = lambda column, parts: reduce(or_, (column.contains(p) for p in parts))
    return (words > 0) & (
        ~(F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1).isin(*TERMINAL) | any_of(line, ENDED))
        | (_count(line, SEPARATOR) >= MIN_SEPARATORS)
        | any_of(low, BOILERPLATE)
        | (100 * _count(line, NOISE) > MAX_NOISE * words)
        | line.rlike(NAVIGATION)
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT``: counts, base rules, verdict, and the text without its failing lines."""
    docs = docs.drop(*RESULT)
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", _words(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn("n_words", F.size("_words").cast("bigint"))
    # windows of three words, sorted so that equal ones are neighbours
    at = lambda i: F.get("_words", i)
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn("_windows", F.sort_array(windows))
    pairs = F.zip_with("_windows", F.slice("_windows", 2, F.greatest(F.size("_windows"), F.lit(1))), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    df = df.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    covered = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))).cast("bigint"))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x))
    worded = F.filter("_lines", lambda x: x.rlike(NON_SPACE))
    df = df.withColumn("_worded", worded)
    df = df.withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("bigint"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
    bare = reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit("")), SYMBOLS, F.col("_text"))
    df = df.withColumn("n_symbols", (F.octet_length("_text") - F.octet_length(bare)).cast("bigint"))
    # line rules
    counted = F.transform("_lines", lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), F.size(_words(x)).alias("n")))
    df = df.withColumn("_counted", counted)
    df = df.withColumn("_passed", F.filter("_counted", lambda x: ~line_fails(x["line"], x["low"], x["n"])))
    df = df.withColumn("n_kept_words", F.aggregate("_passed", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    lost = F.col("n_words") - F.col("n_kept_words")
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * lost <= MAX_LOST * F.col("n_words")))
    df = df.withColumn("clean_text", F.array_join(F.transform("_passed", lambda x: x["line"]), "\n"))
    # a filter on a result must not be moved below the steps above, where it would repeat them for every element; rows have a number >= 0
    df = df.withColumn("_row", F.monotonically_increasing_id())
    return df.select(*docs.columns, *[F.when(F.col("_row") >= 0, F.col(c)).alias(c) for c in RESULT])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs).drop("text", "clean_text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, their failing lines removed; the columns of ``docs``."""
    kept = measure(docs).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
