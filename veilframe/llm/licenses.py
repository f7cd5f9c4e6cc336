"""License scan: fixed phrases, and an exact set-similarity join of text blocks with templates.

A template's blocks are the windows of consecutive words of a paragraph that are 1 / CONTAINMENT times
as long as the template; line breaks don't end a block, blank lines do. A word that starts successive lines, as
comment marks may, is also tried as no part of the text. A block matches a template when it holds at
least CONTAINMENT of the template's distinct words. The join is exact: template words are ordered by
the number of texts of the whole corpus that hold them, rarest first, and a block that misses all of a
template's first |T| - need + 1 words can't hold `need` of them (prefix filter); a paragraph with
fewer than `need` distinct words can't either (length filter); and once the first word found is at place
i, at most |T| - i can match (positional filter). The filters are put to paragraphs, which hold
their blocks; what passes is verified block by block.

All steps are DataFrame expressions. The texts are read twice, for the frequencies and for everything
else; the second reading is written as one short row a document, which carries only those
paragraphs that hold a prefix word. Templates are a fixed list, so their index is a bounded broadcast. Matches
meet their rows by a number of the written row, so equal rows don't meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, written

CONTAINMENT = 0.8
#: A line break, and any lines without a word after it.
PARAGRAPH = r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+\n)++"
#: Words, as runs of what [^\x00-\x2F\x3A-\x60\x7B-\x7F] allows: stated by what it holds, as negated unions are slow in Java.
LETTER = r"[a-z0-9\x{80}-\x{10FFFF}]"
WORD = LETTER + "++"
#: The same words before A-Z is lower-cased.
RAW_LETTER = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]"
RAW_WORD = RAW_LETTER + "++"
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
#: Notices by which public licenses are applied to works, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many texts hold each vocabulary word; one row per word reaches the driver."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r.word: r.n for r in found.collect()}


def template_index(frequencies: dict[str, int], templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> list[tuple]:
    """One row per template and prefix place: (token, tid, label, place, size, need, length, before, words).

    length is that of the template's blocks, in words.
    """
    rows = []
    for tid, (label, text) in enumerate(templates):
        words = sorted(_words(text), key=lambda w: (frequencies.get(w, 0), w))
        need = -int(-containment * len(words) // 1)
        length = -int(-len(re.findall(r"[a-z0-9]+", text.lower())) / containment // 1)
        for place in range(len(words) - need + 1):
            rows.append((words[place], tid, label, place, len(words), need, length, words[:place], words))
    return rows


def _told(block: Column) -> Column:
    return F.regexp_extract_all(block, F.lit(WORD), F.lit(0))


def _unled(block: Column) -> Column:
    """The block without words that start a line and one next to it."""
    lead = rf"^[^a-z0-9\x{{80}}-\x{{10FFFF}}]*+({WORD})"
    lines = F.split(block, "\n")
    leads = F.transform(lines, lambda x: F.regexp_extract(x, lead, 1))
    shared = lambda i: (F.get(leads, i) != "") & (F.get(leads, i).eqNullSafe(F.get(leads, i - 1)) | F.get(leads, i).eqNullSafe(F.get(leads, i + 1)))
    return F.array_join(F.transform(lines, lambda x, i: F.when(shared(i), F.regexp_replace(x, lead, "")).otherwise(x)), "\n")


def _held(told: Column, words: Column, length: Column) -> Column:
    """The most template words that a run of `length` of the told words holds; it starts with one, without loss."""
    starts = F.filter(F.sequence(F.lit(1), F.size(told)), lambda i: F.array_contains(words, F.get(told, i - 1)))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(words, F.slice(told, i, length)))))


def paragraph_matches(rows: DataFrame, index: list[tuple]) -> DataFrame:
    """(row, paragraphs) to (row, label, tid, contained): every template of which a block of a row's paragraphs meets the threshold."""
    prefix = sorted({entry[0] for entry in index})
    known = rows.sparkSession.createDataFrame(index, "token string, tid int, label string, place int, size int, need int, length int, before array<string>, words array<string>")
    parts = rows.select("row", F.explode("paragraphs").alias("block"))
    parts = parts.select("row", F.explode(F.array_distinct(F.array("block", _unled(F.col("block"))))).alias("block"))
    told = parts.select("row", _told(F.col("block")).alias("told")).withColumn("found", F.array_distinct("told"))
    keyed = told.withColumn("token", F.explode(F.array_intersect("found", F.array(*map(F.lit, prefix)))))
    met = keyed.join(F.broadcast(known), "token").where((F.size("found") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")) & ~F.arrays_overlap("found", "before"))
    able = met.where(F.size(F.array_intersect("words", "found")) >= F.col("need"))
    held = able.withColumn("held", _held(F.col("told"), F.col("words"), F.col("length"))).where("held >= need")
    return held.select("row", "label", "tid", (F.col("held") / F.col("size")).alias("contained"))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Word indices where the phrase starts."""
    return F.filter(
        F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>")),
        lambda i: F.get(words, i).eqNullSafe(F.lit(phrase[0])) & _rest(words, i, phrase),
    )


def _rest(words: Column, i: Column, phrase: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k, word in enumerate(phrase[1:], 1):
        out = out & F.get(words, i + k).eqNullSafe(F.lit(word))
    return out


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    docs needs doc_id and text; null text counts as empty. Base places are those of the fixed
    phrases; labels adds those of matching templates; score is 1 with a base place, else the best
    containment found, else 0. Texts of any length are read whole. Repeated rows stay and get equal
    results; other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for _, text in templates for w in _words(text)})
    index = template_index(word_frequencies(docs, vocabulary), templates, containment)
    rare = rf"(?i)(?<!{RAW_LETTER})(?:" + "|".join(sorted({entry[0] for entry in index})) + rf")(?!{RAW_LETTER})"
    text = F.col("text")
    none = F.array().cast("array<string>")
    words = F.when(text.rlike("(?i)license"), _told(ascii_lower(text))).otherwise(none)
    paragraphs = F.when(text.rlike(rare), F.filter(F.split(ascii_lower(text), PARAGRAPH), lambda x: x.rlike(rare))).otherwise(none)
    based = docs.select("doc_id", F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), words.alias("words"), paragraphs.alias("paragraphs"))
    based = based.select("doc_id", "n_words", "paragraphs", *[_places(F.col("words"), phrase).alias(label) for label, phrase in BASE.items()])
    starts = F.concat(*[F.col(label) for label in BASE])
    base_labels = F.array_sort(F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in BASE]), lambda x: x.isNotNull()))
    based = based.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "paragraphs", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), base_labels.alias("base"),
    )
    rows, _ = written(based, "licenses")
    matched = paragraph_matches(rows, index).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("contained").alias("best"))
    # Rows without a candidate paragraph, nearly all, don't move.
    able = rows.where(F.size("paragraphs") > 0).drop("paragraphs").join(matched, "row", "left")
    alone = rows.where(F.size("paragraphs") == 0).drop("paragraphs").withColumn("more", none).withColumn("best", F.lit(0.0))
    return able.unionByName(alone).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
