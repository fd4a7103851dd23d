"""License scans by an exact set-similarity join of text blocks with license templates.

A text's blocks are its lines and, across line ends, every run of as many words as a template has: comment signs aren't words, so a notice is
found as it is wrapped in a source header. A block is a hit for a template if it holds at least CONTAINMENT of the template's distinct words.
The join is exact: words are ordered by their frequency over all blocks, rarest first; a block that reaches a template's least overlap must hold one
of the template's first (size - overlap + 1) words (prefix filter), must have enough words of the vocabulary (length filter), and the words
that follow a shared one on both sides must suffice for the overlap (positional filter); what passes is verified by intersection. Runs pass
the same filters in the same order of words, but where they stand: they overlap, so that a row for each would repeat a text as often as a
template is long. Only texts of several lines that as a whole hold enough of a template's words have runs to look at (no run of another text
can be a hit). Besides, phrases are found where their words stand consecutively. All of it is DataFrame expressions.

Defined cases: a null text counts as empty and has no words; rows may repeat and doc_id may be null; labels are empty strings where there
are none; a template counts once per text however many blocks hold it; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CONTAINMENT = 0.8
#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public notices of licenses and the labels of the texts that hold them.
TEMPLATES = [
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "Released under the MIT License. See the LICENSE file for details."),
    ("mit-notice", "This project is licensed under the MIT License"),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("apache-2-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("reserved-notice", "All rights reserved. No part of this publication may be reproduced or transmitted in any form"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs between words (after lower-casing) and within them; the last class is for texts that aren't lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WITHIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
WITHIN_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: str) -> list[str]:
    return re.findall(WITHIN + "+", text.translate(str.maketrans(UPPER, LOWER)))


def least_overlap(size: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(round(containment * size, 9))


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _split(text: Column) -> Column:
    """The words of a lower-cased text, in order."""
    return F.filter(F.split(text, BETWEEN + "+"), lambda w: w != "")


def _listed(text: Column) -> Column:
    """The words of a text that holds a phrase, else null: only there words must be numbered."""
    between = BETWEEN.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60") + "+"
    alike = "|".join(f"(?:{between.join(p.split())})" for p in PHRASES)
    return F.when(text.rlike(f"(?i)(?<!{WITHIN_ANY})(?:{alike})(?!{WITHIN_ANY})"), _split(_lower(text)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _runs(held: Column, templates: Column) -> Column:
    """(label, share) of the templates that a run of their length holds enough of.

    held: the words of the vocabulary in a text, and where they stand; the words of a template are in the global order. A run with the most
    words of a template may begin with one of them, and as many of them as the template is long go into it at most.
    """

    def most(t: Column) -> Column:
        here = F.filter(F.transform(held, lambda x: F.struct(x["at"].alias("at"), F.array_position(t["words"], x["word"]).alias("place"))), lambda x: x["place"] > 0)
        size = F.size(t["words"])

        def overlap(here: Column) -> Column:
            def places(first: Column, i: Column) -> Column:
                run = F.filter(F.slice(here, i + 1, t["span"]), lambda x: x["at"] < first["at"] + t["span"])
                # length filter: the last of the words that are needed stands in the run
                return F.when(F.get(here, i + t["need"] - 1)["at"] < first["at"] + t["span"], F.transform(run, lambda x: x["place"]))

            # prefix and positional filter: the run's first word in the order is followed by enough others of the template
            passed = F.filter(F.transform(here, places), lambda p: F.array_min(p) <= size - t["need"] + 1)
            return F.array_max(F.transform(passed, lambda p: F.size(F.array_distinct(p))))

        return F.struct(t["label"].alias("label"), t["need"].alias("need"), _bound(here, overlap).alias("overlap"), size.alias("size"))

    enough = F.filter(F.transform(templates, most), lambda x: x["overlap"] >= x["need"])
    return F.transform(enough, lambda x: F.struct(x["label"].alias("label"), (x["overlap"] / x["size"]).alias("share")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs."""
    spark = docs.sparkSession
    sets = [(k, label, sorted(set(words(t)))) for k, (label, t) in enumerate(templates or TEMPLATES)]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    least = min(least_overlap(len(s), containment) for _, _, s in sets)

    # one pass over the texts: what is needed of each goes to a table
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), body.alias("text")).withColumn("n_words", F.regexp_count("text", F.lit(WITHIN_ANY + "+")).cast("long"))
    base = base.withColumn("lists", _listed(F.col("text")))
    found = F.flatten(F.array(*[_places(F.col("lists"), p.split(), label) for p, label in PHRASES.items()]))
    base = base.withColumn("places", F.when(F.col("lists").isNotNull(), found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")))
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    blocks = F.transform(F.split(_lower(F.col("text")), "\n"), lambda line: F.array_intersect(F.split(line, BETWEEN + "+"), vocab))
    base = base.withColumn("blocks", blocks)
    given = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(w) for w in s]).alias("words"), F.lit(least_overlap(len(s), containment)).alias("need")) for k, _, s in sets])
    fit = _bound(F.array_distinct(F.flatten("blocks")), lambda held: F.filter(given, lambda t: F.size(F.array_intersect(held, t["words"])) >= t["need"]))
    base = base.withColumn("fit", F.when(F.size("blocks") > 1, F.transform(fit, lambda t: t["k"])))
    held = F.filter(F.transform(_split(_lower(F.col("text"))), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(vocab, x["word"]))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "key", "n_words", "places", "blocks", "fit", F.when(F.size("fit") > 0, held).alias("held"))
    rows = materialize(spark, rows, "blocks")

    # the global order: words of the templates by the number of blocks that hold them, at most the vocabulary's size
    seen = rows.select(F.explode("blocks").alias("block")).select(F.explode("block").alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.limit(len(vocabulary)).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}

    # prefixes of the templates, a row for each of their rarest words: as many as the templates have words at most
    index = []
    for k, label, s in sets:
        need = least_overlap(len(s), containment)
        order = sorted(s, key=rank.__getitem__)
        index += [(w, k, label, order, need, i) for i, w in enumerate(order[: len(order) - need + 1])]
    index = F.broadcast(spark.createDataFrame(index, "word string, template int, label string, words array<string>, need int, place int"))
    ranks = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, rank int"))

    long = rows.select("row", F.posexplode("blocks").alias("block", "words_in")).where(F.size("words_in") >= least)
    word = long.select("row", "block", "words_in", F.explode("words_in").alias("word")).join(ranks, "word")
    # how many of the block's words come after this one in the order
    number = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    after = F.size(F.filter("words_in", lambda w: number[w] > F.col("rank")))
    hit = word.join(index, "word").where(F.size("words_in") >= F.col("need"))
    hit = hit.where(F.least(after, F.size("words") - F.col("place") - 1) + F.least(F.col("place"), F.size("words_in") - 1 - after) + 1 >= F.col("need"))
    hit = hit.withColumn("overlap", F.size(F.array_intersect("words_in", "words"))).where("overlap >= need")
    best = hit.groupBy("row").agg(F.collect_set("label").alias("method"), F.max(F.col("overlap") / F.size("words")).alias("best"))

    def ordered(k: int, label: str, held: list[str], span: int) -> Column:
        words_of = F.array(*[F.lit(w) for w in sorted(held, key=rank.__getitem__)])
        return F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), words_of.alias("words"), F.lit(least_overlap(len(held), containment)).alias("need"), F.lit(span).alias("span"))

    given = F.array(*[ordered(k, label, s, len(words(t))) for (k, label, s), (_, t) in zip(sets, templates or TEMPLATES, strict=True)])
    runs = F.when(F.size("fit") > 0, _runs(F.col("held"), F.filter(given, lambda t: F.array_contains("fit", t["k"]))))
    rows = rows.withColumn("runs", F.coalesce(runs, F.array().cast("array<struct<label:string,share:double>>"))).drop("blocks", "fit", "held")

    out = rows.join(materialize(spark, best, "hits"), "row", "left")
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    method = F.array_union(F.coalesce("method", F.array().cast("array<string>")), F.transform("runs", lambda x: x["label"]))
    best = F.greatest("best", F.array_max(F.transform("runs", lambda x: x["share"])))
    at = F.transform("places", lambda p: p["at"])
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, method)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _starts(lists: Column, phrase: list[str]) -> Column:
    """The indices at which the phrase's words stand one after another."""
    last = F.size(lists) - len(phrase)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.slice(lists, i + 1, len(phrase)) == F.array(*[F.lit(w) for w in phrase]))


def _places(lists: Column, phrase: list[str], label: str) -> Column:
    return F.transform(_starts(lists, phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB, by brute force over all blocks and templates, and over all runs of texts of several lines."""
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    cut = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = ", ".join(f"({k}, '{label}', {sorted(set(words(t)))!r}, {len(words(t))})" for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM {table}),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{cut}'), lambda x: x <> '') AS ws FROM d),
phrases(p, label) AS (VALUES {phrases}),
places AS (
    SELECT r, label, i - 1 AS pos FROM (SELECT r, p, label, ws, unnest(range(1, len(ws) - len(p) + 2)) AS i FROM w, phrases) WHERE ws[i:i + len(p) - 1] = p
),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b, list(DISTINCT label) AS labels FROM places GROUP BY r),
templates(k, label, words, span) AS (VALUES {listed}),
blocks AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
block_words AS (SELECT r, list_distinct(regexp_split_to_array(line, '{cut}')) AS bw FROM blocks),
hits AS (
    SELECT r, label, len(list_intersect(bw, words)) / len(words)::DOUBLE AS share FROM block_words, templates
    WHERE len(list_intersect(bw, words)) >= ceil(round({CONTAINMENT} * len(words), 9))
),
fit AS (
    SELECT r, ws, label, words, span FROM w, templates
    WHERE contains(t, chr(10)) AND len(list_intersect(list_distinct(ws), words)) >= ceil(round({CONTAINMENT} * len(words), 9))
),
runs AS (
    SELECT r, label, max(len(list_intersect(list_distinct(ws[i:i + span - 1]), words))) / any_value(len(words))::DOUBLE AS share, any_value(len(words)) AS size
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM fit) GROUP BY r, label, words
),
found AS (SELECT r, label, share FROM hits UNION ALL SELECT r, label, share FROM runs WHERE round(share * size) >= ceil(round({CONTAINMENT} * size, 9))),
best AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(best.labels, []))), ','), '') AS labels,
    CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
