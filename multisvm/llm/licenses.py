"""License scans with DataFrame functions only.

Windows of shingles overlap, MinHash bands of each window retrieve
templates by an equi-join, and exact shingle containment decides.

- Words are runs of letters and digits, lower-cased; shingles are five words
  (a template of fewer words is one shingle of its own length).
- A template of L shingles is looked for in windows of ``reach`` x L shingles
  that start at every multiple of L. An occurrence lies inside some window
  whatever its start if it spans up to (reach - 1) x L + 1 shingles: with the
  default reach of 2 that holds for unedited notices, while one with inserted
  words is found or not by where it starts. A reach of 4, the query's, holds
  notices of up to three times their length.
- A match of containment 0.8 has Jaccard similarity of at least 0.8 / (reach +
  0.2), 0.36 for a reach of 2; there are as many bands of one row (64, or 131
  for a reach of 4) as retrieve a window that matches with probability over
  1 - 1e-12.
- A band value is the hash of one shingle, so only windows that hold a shingle
  which is some template's band minimum can collide; all others are passed
  over without computing their signatures (exact, no loss).

The template table is a parameter and bounded (every template's shingles go
into the plan); the documents' side never leaves its partition before the
matches are grouped by document.

Defined cases: null or empty text has no match and gives no row; rows of one
doc_id, of the same or different texts, give the matches of any of them once (a
window number that matches in several counts once); null doc_id is an id of its own;
equal templates are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multisvm.llm.common import let

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64  # at least; see ``bands_for``
REACH = 2  # length of a window in template lengths
LONG_REACH = 4  # of the query
MISS = 1e-12  # of a window that matches
NOT_WORD = "[^\\p{L}\\p{N}]+"

# Short notices and the opening of well-known headers (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-line", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def _shingle(n: int, at: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"_w[{at} + {k}]" for k in range(n)) + ")"


def _shingles(n: int, low: str, high: str) -> str:
    """Shingle hashes of n words that start at low .. high - 1 (SQL)."""
    return f"if({high} > {low}, transform(sequence({low}, {high} - 1), i -> {_shingle(n)}), array())"


def bands_for(reach: int, containment: float) -> int:
    """Bands of one row that miss a match with probability MISS at most."""
    jaccard = containment / (1 + reach - containment)
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-jaccard))) if jaccard < 1 else BANDS


def _signature(of: str, bands: int) -> str:
    return f"transform(sequence(0, {bands - 1}), j -> array_min(transform({of}, h -> xxhash64(h, j))))"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def template_table(spark, templates=TEMPLATES, bands: int = BANDS) -> list:
    """Rows (template_id, first words, n, shingles, signature, anchors); at most
    one shingle a word of the template table, so it may be collected."""
    t = spark.createDataFrame(templates, "template_id string, body string").withColumn("_w", _words(F.col("body")))
    t = t.where("size(_w) > 0")
    rows = []
    lengths = sorted({r.n for r in t.select(F.least(F.size("_w"), F.lit(SHINGLE)).alias("n")).distinct().collect()})
    for n in lengths:
        own = t.where(F.least(F.size("_w"), F.lit(SHINGLE)) == n)
        own = own.select("template_id", "_w", F.expr(_shingles(n, "0", f"size(_w) - {n - 1}")).alias("shingles"))
        own = own.select("template_id", "_w", "shingles", F.expr(_signature("shingles", bands)).alias("signature"))
        # anchors: (band minimum's shingle, its first word)
        own = own.select(
            "template_id", F.lit(n).alias("n"), F.size("shingles").alias("span"), "shingles", "signature",
            F.expr(
                "transform(filter(sequence(0, size(shingles) - 1), i -> exists(sequence(0, size(signature) - 1),"
                " j -> xxhash64(shingles[i], j) = signature[j])), i -> struct(shingles[i] as h, _w[i] as w))"
            ).alias("anchors"),
        )
        rows += own.collect()
    return rows


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  containment: float = CONTAINMENT, reach: int = REACH) -> DataFrame:
    """One row a document and template found in it: id, template_id,
    containment (largest over the windows), n_windows (windows that match),
    first_word (position of the first template shingle in a matching window).
    Windows are ``reach`` (2 or more) template lengths long.
    """
    spark = df.sparkSession
    if reach < 2:
        raise ValueError("windows of one template length do not overlap")
    n_bands = bands_for(reach, containment)
    known = template_table(spark, templates, n_bands)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    found = None
    for n in sorted({r.n for r in known}):
        of = [r for r in known if r.n == n]
        first = sorted({a.w for r in of for a in r.anchors})
        anchors = sorted({a.h for r in of for a in r.anchors})
        spans = sorted({r.span for r in of})

        def held(w, n=n, first=first, anchors=anchors):
            """Positions of the template's band shingles."""
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
            return F.filter(starts, lambda i: F.get(w, i).isin(first)
                            & F.xxhash64(*[F.get(w, i + k) for k in range(n)]).isin(anchors))

        def windows(w, hits, n=n, spans=spans):
            """Every window of each size that holds a hit, with its shingles."""
            def around(span):
                return F.flatten(F.transform(hits, lambda p: F.array(*[
                    F.struct(F.lit(span).alias("span"), (F.floor(p / span) - back).alias("at")) for back in range(reach)
                ])))

            number = [around(span) for span in spans]
            return F.transform(F.array_distinct(F.filter(F.concat(*number), lambda x: x["at"] >= 0)), lambda x: F.struct(
                x["span"].alias("span"), x["at"].alias("at"),
                F.transform(
                    F.sequence(x["at"] * x["span"], F.least((x["at"] + reach) * x["span"], F.size(w) - (n - 1)) - 1),
                    lambda i: F.xxhash64(*[F.get(w, (i + k).cast("int")) for k in range(n)]),
                ).alias("sh"),
            ))

        # explode_outer: no filter over the whole expression is inferred and pushed below it
        wins = docs.select("_id", F.explode_outer(let(_words(F.col("_t")), lambda w: let(held(w), lambda h: windows(w, h)))).alias("win"))
        wins = wins.where("win is not null").select("_id", "win.*")
        banded = wins.select("_id", "span", "at", "sh", F.posexplode_outer(F.expr(_signature("sh", n_bands))).alias("band", "value"))
        bands = spark.createDataFrame(
            [(r.template_id, r.span, j, v) for r in of for j, v in enumerate(r.signature)],
            "template_id string, span int, band int, value long",
        )
        shingles = spark.createDataFrame([(r.template_id, r.shingles) for r in of], "template_id string, tsh array<long>")
        # the template side is bounded by the template table: a row a band each
        candidates = (
            banded.join(F.broadcast(bands), ["span", "band", "value"])
            .groupBy("_id", "template_id", "span", "at", F.xxhash64("sh").alias("text")).agg(F.first("sh").alias("sh"))
        )
        exact = candidates.join(F.broadcast(shingles), "template_id").select(
            "_id", "template_id", "at",
            (F.size(F.array_intersect("tsh", "sh")) / F.size(F.array_distinct("tsh"))).alias("share"),
            F.expr("at * span + array_min(transform(filter(sequence(0, size(sh) - 1), i -> array_contains(tsh, sh[i])), i -> i))").alias("at_word"),
        ).where(F.col("share") >= containment)
        found = exact if found is None else found.unionByName(exact)
    if found is None:
        found = docs.select("_id", F.lit("").alias("template_id"), F.lit(0).alias("at"), F.lit(0.0).alias("share"), F.lit(0).alias("at_word")).where("false")
    return found.groupBy("_id", "template_id").agg(
        F.max("share").alias("containment"), F.count_distinct("at").alias("n_windows"), F.min("at_word").cast("long").alias("first_word")
    ).withColumnRenamed("_id", id_col)
