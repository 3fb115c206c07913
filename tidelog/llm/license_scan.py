"""License scans by diagonal voting.

A template is a list of words. All rolling word k-gram hashes of a text are joined with the k-gram hashes of the
templates; a hit at text position p and template position q whose first and last words are the same votes for the
diagonal p - q. Votes are gathered by diagonal and neighbouring diagonals (a word more or less in the text) are merged.
A span is verified by the share of the template's positions that have voted for it, each once: all of them, on one
diagonal, for a short phrase, MIN_COVER for a longer template. As every gram's words are compared at both ends, the words
of a run of grams are all compared.

Templates of up to BROADCAST_WORDS words in all are broadcast; more are met by a plain join.
Positions count words from 0. Words of long texts are never cut into blocks, so no gram is lost at an edge.

Defined results
---------------
- null or empty text: no words, no places, empty labels, score 0, null positions.
- null doc_id: kept as it is. ties and repeated rows: one result for each row.
- very long texts: whole. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

#: What ends a word: every ASCII character but digits and letters. Texts are lower-cased first.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORT_K, LONG_K = 2, 4
MIN_COVER = 0.75
#: Diagonals at most this far apart are one span.
NEIGHBOURS = 4
BROADCAST_WORDS = 100_000

#: Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening sentences of well-known licenses, with labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def words_of(text: str) -> list[str]:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(BREAKS, low) if w]


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words."""
    return F.when(F.size(words) >= 2, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _fours(pairs: Column) -> Column:
    """Hashes of four words from those of two."""
    n = F.size(pairs) - 2
    return F.when(n >= 1, F.zip_with(F.slice(pairs, 1, n), F.slice(pairs, 3, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(gram, k, template, label, base, at, grams, head, tail): every k-gram of every template with its position, their
    number, and its first and last word."""
    rows, k = [], 0
    for base, group in ((True, phrases), (False, templates)):
        for a, b in group.items():
            text, label = (a, b) if base else (b, a)
            rows.append((k, label, base, words_of(text)))
            k += 1
    if any(len(r[3]) < (SHORT_K if r[2] else LONG_K) for r in rows):
        raise ValueError("a phrase needs two words, a template four")
    t = spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    t = t.withColumn("pairs", _pairs(F.col("words")))
    t = t.withColumn("hashes", F.when(F.col("base"), F.col("pairs")).otherwise(_fours(F.col("pairs"))))
    t = t.select("template", "label", "base", "words", F.when(F.col("base"), SHORT_K).otherwise(LONG_K).alias("k"), F.size("hashes").alias("grams"), F.posexplode("hashes").alias("at", "gram"))
    t = t.select("gram", "k", "template", "label", "base", "at", "grams", F.get("words", F.col("at")).alias("head"), F.get("words", F.col("at") + F.col("k") - 1).alias("tail"))
    return F.broadcast(t) if sum(len(r[3]) for r in rows) <= BROADCAST_WORDS else t


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans, per row of docs.

    spans has every verified span: label, first word, words, share of the template, and whether it is a base phrase.
    """
    spark = docs.sparkSession
    d = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), F.array_remove(F.split(ascii_lower(text_of(docs)), BREAKS), "").alias("words"))
    d = d.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), _pairs(F.col("words")).alias("pairs"))
    # One gram that no template has stands for the row itself: it carries n_words through the join.
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("gram"), F.lit(0).alias("k"), none.alias("first_"), none.alias("last_")))

    def grams(k: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda g, i: F.struct(i.alias("pos"), g.alias("gram"), F.lit(k).alias("k"), F.get("words", i).alias("first_"), F.get("words", i + (k - 1)).alias("last_")))

    hits = d.select("row", "doc_id", "n_words", F.explode(F.concat(own, grams(SHORT_K, F.col("pairs")), grams(LONG_K, _fours(F.col("pairs"))))).alias("g")).select("row", "doc_id", "n_words", "g.*")
    t = template_grams(spark, phrases, templates)
    hits = hits.join(t, ["gram", "k"], "left").where("first_ = head and last_ = tail or pos = -1")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("voted"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    # Neighbouring diagonals of a longer template become one span; those of a phrase stay alone.
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(near) > NEIGHBOURS), F.lit(True)).cast("int")
    runs = votes.withColumn("new", new).withColumn("span", F.sum("new").over(near))
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("votes"), F.min(F.col("diagonal") + F.col("lo")).alias("first"), F.max(F.col("diagonal") + F.col("hi")).alias("last"))
    spans = spans.withColumn("share", F.col("votes") / F.col("grams"))
    good = F.col("template").isNotNull() & F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(F.col("share") >= MIN_COVER)
    base = good & F.col("base")
    span = F.struct("label", F.col("first").cast("long").alias("first_word"), (F.col("last") - F.col("first") + F.when(F.col("base"), SHORT_K).otherwise(LONG_K)).cast("long").alias("words"), "share", "base")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        join(base).alias("base_labels"),
        join(good).alias("labels"),
        F.coalesce(F.max(F.when(F.col("base"), F.when(good, F.lit(1.0))).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, span))).alias("spans"),
    )
    return out.drop("row")
