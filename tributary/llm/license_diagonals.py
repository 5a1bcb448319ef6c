"""Licence scans by diagonal voting, in columns only.

All rolling three-word grams of all texts meet the grams of the licence templates in one hash join. A hit at word ``p`` of a text and word
``t`` of a template votes for the diagonal ``p - t``, where the template would start; the votes of a diagonal are bit masks of the
template's words, a mask for every ``MASK`` of them, so that repeated hits count once and templates may be whole licences. Diagonals of a template that
lie within ``DRIFT`` words are one span with words put in or left out; its masks are joined. A span is verified if its grams, which the join has compared word
by word, touch ``COVER`` of the template's words. Base phrases are templates that must be touched whole on one diagonal, which is to stand there
word for word.

The templates are a fixed table that is broadcast. Hashes that no template has are dropped inside the text's own row; only hits become rows, and a row per text.

Defined results: null text is empty; a text without words has count 0, no places, empty labels and score 0; repeated rows (equal id and
text) get equal results each; a null id is an id of its own; an empty table gives an empty result; extra columns are ignored. Texts may be of any length and cost
their number of words.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K, DRIFT, COVER, MASK = 3, 3, 0.8, 62
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels that are asked for as they are.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Phrases of usual licence texts and notices, in lower case, without punctuation.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _gram(words: str, at: Column) -> list[Column]:
    return [F.get(words, at + i) for i in range(K)]


def template_grams(spark: SparkSession, base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(hash, gram, template, label, exact, place, size): a row per gram, and one with template -1 that meets every text once."""
    every = [(*x, True) for x in base] + [(*x, False) for x in templates]
    if any(len(phrase.split()) < K for _, phrase, _ in every):
        raise ValueError(f"a template has {K} words or more")
    structs = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.split(F.lit(phrase), " ").alias("w")) for i, (label, phrase, exact) in enumerate(every)]
    table = spark.range(1).select(F.inline(F.array(*structs)))
    table = table.select("template", "label", "exact", "w", F.size("w").alias("size"))
    table = table.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - K)).alias("place"))
    gram = _gram("w", F.col("place"))
    table = table.select(F.xxhash64(*gram).alias("hash"), F.concat_ws(" ", *gram).alias("gram"), "template", "label", "exact", "place", "size")
    text = spark.range(1).select(F.lit(0).cast("bigint").alias("hash"), F.lit("").alias("gram"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("exact"), F.lit(0).alias("place"), F.lit(K).alias("size"))
    return table.unionByName(text)


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """(key, text_hash, n_words, template, label, exact, diagonal, block, mask, size): a row per voted diagonal and MASK words, and a row of template -1 per text."""
    table = template_grams(docs.sparkSession, base, templates)
    asked = [r.hash for r in table.filter("template >= 0").select("hash").distinct().collect()]
    df = docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words_of(F.col(text)).alias("_words"))
    n = F.size("_words")
    starts = F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(F.array().cast("array<int>"))
    # the words stay in their row: what leaves it are the grams of which a template has the hash
    starts = F.filter(starts, lambda i: F.xxhash64(*_gram("_words", i)).isin(asked))
    gram = lambda i: F.struct(i.alias("at"), F.xxhash64(*_gram("_words", i)).alias("hash"), F.concat_ws(" ", *_gram("_words", i)).alias("gram"))
    # the first row of a text has the empty gram of template -1
    alone = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("hash"), F.lit("").alias("gram"))
    df = df.select(key, "text_hash", n.cast("bigint").alias("n_words"), F.concat(F.array(alone), F.transform(starts, gram)).alias("_grams"))
    # there is always one; as an outer one no filter is derived that would work out the grams a second time, word by word
    df = df.select(key, "text_hash", "n_words", F.inline_outer("_grams"))
    met = df.join(F.broadcast(table), ["hash", "gram"])
    word = F.explode(F.sequence(F.col("place"), F.col("place") + K - 1)).alias("word")
    met = met.select(key, "text_hash", "n_words", "template", "label", "exact", (F.col("at") - F.col("place")).alias("diagonal"), "size", word, (F.col("template") == -1).alias("whole"))
    met = met.withColumns({"block": F.floor(F.col("word") / MASK).cast("int"), "bit": F.expr(f"shiftleft(1L, cast(word % {MASK} as int))")})
    return met.groupBy(key, "text_hash", "n_words", "template", "label", "exact", "diagonal", "block", "size").agg(
        F.bit_or("bit").alias("mask"), F.count_if(F.col("whole") & (F.col("word") == 0)).alias("rows")
    )


def spans(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, n_words, template, label, exact, first, last, cover, rows): neighbouring diagonals merged."""
    mine = Window.partitionBy(key, "text_hash", "n_words", "template")
    order = mine.orderBy("diagonal", "block")
    # base phrases do not drift
    drift = F.when(F.col("exact"), 0).otherwise(DRIFT)
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    votes = votes.withColumn("span", F.sum(new.cast("int")).over(order))
    given = [key, "text_hash", "n_words", "template", "label", "exact", "size", "span"]
    merged = votes.groupBy(*given, "block").agg(
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.bit_or("mask").alias("mask"), F.max("rows").alias("rows")
    )
    whole = merged.groupBy(*given).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.bit_count("mask")).alias("touched"), F.max("rows").alias("rows")
    )
    return whole.withColumn("cover", F.col("touched") / F.col("size"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``."""
    found = spans(hits(docs, key, text, base, templates), key)
    place = F.col("exact") & (F.col("cover") == 1)
    verified = place | (~F.col("exact") & (F.col("template") >= 0) & (F.col("cover") >= COVER))
    labels = lambda rows: F.array_join(F.sort_array(F.collect_set(F.when(rows, F.col("label")))), ",")
    per_text = found.groupBy(key, "text_hash", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("first"))).cast("bigint").alias("last_word"),
        labels(place).alias("base_labels"),
        labels(verified).alias("labels"),
        F.max(F.when(verified, F.col("cover")).otherwise(0.0)).alias("score"),
        F.max("rows").cast("int").alias("_rows"),
    )
    per_row = per_text.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return per_row.select(key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
