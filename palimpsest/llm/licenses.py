"""License scans: places of set phrases, and an exact set-similarity join of text blocks with notice templates.

A block (up to three lines of a paragraph in a row, as a short notice is wrapped, or a paragraph for long notices) meets a template when it contains at least ``THRESHOLD`` of the
template's distinct tokens.  Tokens are ordered by how many documents have them, rarest first.  A block that meets the
template must hold one of its first |T| - need + 1 tokens (prefix), must have ``need`` template tokens at all (length), and
after the first token in common both must have enough tokens left (position); what remains is verified exactly.
DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

THRESHOLD = 0.8

# The phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public notices, by label.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Templates of up to so many tokens are held against so many lines in a row, longer ones against paragraphs.  A block that
#: holds another meets all that the other meets.
SHORT, LINES = 14, 3
PARAGRAPH = "\n[ \t\r]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text with A-Z lowered, one space apart."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " "))


def templates() -> list[tuple[int, str, str, list[str], int]]:
    """(number, label, unit, distinct tokens, tokens needed)."""
    out = []
    for k, (label, text) in enumerate(NOTICES):
        tokens = sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))
        out.append((k, label, "window" if len(tokens) <= SHORT else "paragraph", tokens, math.ceil(THRESHOLD * len(tokens) - 1e-9)))
    return out


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_columns(digest: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base (an array of labels) to rows with ``norm``."""
    df = digest.withColumn("n_words", F.when(F.col("norm") == "", F.lit(0)).otherwise(spaces(F.col("norm")) + 1).cast("bigint"))
    df = df.withColumn("padded", F.concat(F.lit(" "), "norm", F.lit(" ")))
    n, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        has = F.contains("padded", F.lit(f" {phrase} "))
        n.append(F.when(has, F.regexp_count("padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        first.append(F.when(has, spaces(F.substring_index("padded", f" {phrase} ", 1)).cast("bigint")))
        last.append(F.when(has, F.col("n_words") - spaces(F.substring_index("padded", f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    return df.select("*", total.cast("bigint").alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).cast("bigint").alias("last_word"), F.array_compact(F.array(*labels)).alias("base")).drop("padded")


def template_rows(spark: SparkSession, frequency: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """The prefix index: (token, label, unit, place, size, need, tokens); and the rank of each token, rarest first.  Its size is that of NOTICES."""
    vocabulary = sorted({t for x in templates() for t in x[3]}, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: k for k, t in enumerate(vocabulary)}
    rows = []
    for _, label, unit, tokens, need in templates():
        ordered = sorted(tokens, key=rank.get)
        for place, token in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append(F.struct(F.lit(token).alias("token"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.lit(place).alias("place"), F.lit(len(ordered)).alias("size"), F.lit(need).alias("need"), F.array(*map(F.lit, ordered)).alias("tokens")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*"), rank


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty.  base_labels come from places where a phrase's words stand in a row; labels add those of the
    templates that a block of the text meets; both are distinct, sorted and joined by commas, empty if there are none.
    score is 1 with a base label, else the best containment of a template that is met, else 0.  Rows that repeat have
    equal results; null doc_ids are kept; texts of any length are read whole; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = sorted({t for x in templates() for t in x[3]})
    words = F.array(*map(F.lit, vocabulary))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = base_columns(base.withColumn("norm", normal(F.col("text")))).withColumn("present", F.array_intersect(F.split("norm", " "), words))
    # A text without enough of any template's tokens has no block that meets one; the others keep their text.
    may = F.lit(False)
    for _, _, _, tokens, need in templates():
        may = may | (F.size(F.array_intersect("present", F.array(*map(F.lit, tokens)))) >= need)
    small = written(digest.withColumn("text", F.when(may, F.col("text"))).withColumn("key", F.sha2("text", 256)).drop("norm"), "licenses")
    frequency = {r.token: r.n for r in small.select(F.explode("present").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    prefixes, rank = template_rows(spark, frequency)
    ranked = F.create_map(*[x for t, k in rank.items() for x in (F.lit(t), F.lit(k))])
    ordered = F.array(*[F.lit(t) for t in sorted(rank, key=rank.get)])
    texts = small.filter("text is not null").select("key", "text").dropDuplicates(["key"])
    # Of every line of every paragraph, the template tokens.
    lines = texts.select("key", F.transform(F.split("text", PARAGRAPH), lambda p: F.transform(F.split(p, "\n"), lambda x: F.array_intersect(F.split(normal(x), " "), words))).alias("p"))
    # In the global order: intersecting keeps the order of the first array.
    block = lambda unit, tokens: F.struct(F.lit(unit).alias("unit"), F.array_intersect(ordered, F.flatten(tokens)).alias("mine"))
    paragraphs = F.transform("p", lambda p: block("paragraph", p))
    windows = F.flatten(F.transform("p", lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - (LINES - 1), F.lit(1))), lambda k: block("window", F.slice(p, k, LINES)))))
    held = lines.select("key", F.explode(F.array_distinct(F.concat(paragraphs, windows))).alias("b")).select("key", "b.unit", "b.mine").filter(F.size("mine") > 0)
    entries = held.select("key", "unit", "mine", F.posexplode("mine").alias("at", "token"))
    met = (
        entries.join(F.broadcast(prefixes), ["token", "unit"])
        .filter(F.size("mine") >= F.col("need"))
        .filter(1 + F.least(F.col("size") - F.col("place") - 1, F.size("mine") - F.col("at") - 1) + F.least("place", "at") >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("mine", "tokens")))
        .filter(F.col("common") >= F.col("need"))
    )
    found = met.groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    rows = small.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "key")
    # Most texts keep no block and have no key: they don't meet in one partition of the join.
    plain = rows.filter("key is null").withColumns({"more": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")})
    out = rows.filter("key is not null").join(found, "key", "left").unionByName(plain)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    nothing = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", nothing))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
