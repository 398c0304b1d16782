"""License scans by diagonal voting.

Every run of three document words is joined to the places of the same run in license
texts. A match votes for its diagonal, document place less template place; votes are
gathered by diagonal, neighbouring diagonals (words put in or left out) are merged, and a
span is accepted if the template's runs it holds reach a share of all. Short phrases need
one diagonal that holds them whole. The join compares the words, not just their hashes.

Defined cases. Null or empty text: no words, no labels, score 0. Rows that share a doc_id
but not the text are scanned each by its own; equal rows come out as often as they came
in. No rows: no result rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of, words

GRAM = 3
#: Diagonals this close are one occurrence; share of a template's runs that it must hold.
NEAR, SHARE = 4, 0.8

# Phrases that name a license, whole.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening passages of public license texts.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _words(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per run of three words of each license text."""
    rows = []
    for kind, texts in (("phrase", phrases), ("template", templates)):
        for label, text in texts:
            w = _words(text)
            if len(w) < GRAM:
                raise ValueError(f"a license text needs at least {GRAM} words: {text}")
            for i in range(len(w) - GRAM + 1):
                rows.append((kind, label, f"{kind}-{len(w)}-{text[:40]}", len(w) - GRAM + 1, i, *w[i : i + GRAM]))
    schema = "kind string, label string, name string, runs int, at int, a string, b string, c string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("a", "b", "c"))


def matches(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Places where a run of a license text stands in a document, and one row without a
    name for every document."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tid"), words(F.col("text")).alias("w"))
    rows = rows.select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "x"))
    second, third = F.get(F.col("w"), F.col("pos") + 1), F.get(F.col("w"), F.col("pos") + 2)
    rows = rows.withColumn("g", F.xxhash64("x", second, third))
    same = (F.col("g") == F.col("h")) & (F.col("x") == F.col("a")) & (second == F.col("b")) & (third == F.col("c"))
    rows = rows.join(F.broadcast(places), same, "left")  # a few hundred fixed rows
    rows = rows.where(F.col("name").isNotNull() | (F.col("pos") == F.size("w")))
    return rows.select(
        "doc_id", "tid", "kind", "label", "name", "runs", "at", (F.col("pos") - F.col("at")).alias("diagonal"),
        F.size("w").alias("n_words"),
    )


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """Per document: ``doc_id, n_words``; ``starts`` (first words of whole phrases, one for
    each place), ``base_labels``, ``labels`` (both sorted) and ``spans`` of templates."""
    found = stored(matches(docs, template_places(docs.sparkSession, phrases, templates)), "license-matches")
    key = ["doc_id", "tid"]
    lines = found.where("name IS NOT NULL").groupBy(*key, "kind", "label", "name", "runs", "diagonal")
    lines = lines.agg(F.collect_set("at").alias("held"))

    whole = lines.where((F.col("kind") == "phrase") & (F.size("held") == F.col("runs")))
    base = whole.groupBy(*key).agg(
        F.array_sort(F.collect_list("diagonal")).alias("starts"),
        F.array_sort(F.collect_set("label")).alias("base_labels"),
    )

    order = Window.partitionBy(*key, "name").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0))
    part = lines.where("kind = 'template'").withColumn("gap", gap)
    part = part.withColumn("occurrence", F.sum((F.col("gap") > near).cast("int")).over(order))
    spans = part.groupBy(*key, "label", "name", "runs", "occurrence").agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("diagonal").alias("diagonal")
    )
    spans = spans.withColumn("score", F.size("held") / F.col("runs"))
    first = F.col("diagonal") + F.array_min("held")
    last = F.col("diagonal") + F.array_max("held") + GRAM - 1
    longer = spans.groupBy(*key).agg(
        F.max("score").alias("best"),
        F.collect_set(F.when(F.col("score") >= share, F.col("label"))).alias("more"),
        F.array_sort(F.collect_set(F.when(F.col("score") >= share, F.struct(first.alias("first"), last.alias("last"), "label", "score")))).alias("spans"),
    )

    every = found.where("name IS NULL").select(*key, "n_words")
    rows = _null_safe(_null_safe(every, base, key), longer, key)
    no_labels, no_starts = F.array().cast("array<string>"), F.array().cast("array<int>")
    base_labels = F.coalesce("base_labels", no_labels)
    return rows.select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("starts", no_starts).alias("starts"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.coalesce("more", no_labels))).alias("labels"), "spans",
        F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    other = right.withColumnsRenamed({k: f"_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & left[k].eqNullSafe(other[f"_{k}"])
    return left.join(other, on, "left").drop(*[f"_{k}" for k in key])
