"""Licence notices in texts: windows, MinHash bands, exact shingle containment. Column code only.

A shingle is ``SHINGLE`` consecutive words.  For every template length there are overlapping windows
of so many words, an eighth of the length apart.  Windows and templates get MinHash signatures of
``BANDS`` bands of ``ROWS`` values; a template that shares a band with a window is retrieved, and
is found if at least ``LEAST`` of its shingles stand in the window's surroundings (one step more at
either side).  A template at any place lies less than one step behind the start of some window,
so an unchanged copy has a similarity of at least 7 : 9 with it and shares a band with
probability 1 - (1 - 0.60) ** 20 > 1 - 2e-8; at a similarity of 0.55 it is still above 0.999.

A window without any shingle of any template contains nothing; only windows around such shingles
are built.  That drops no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.registry import query, table

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 2

# Licence names and their public notices.
TEMPLATES = (
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free "
     "Software Foundation; either version 2 of the License, or (at your option) any later "
     "version"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free "
     "Software Foundation, either version 3 of the License, or (at your option) any later "
     "version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case words: ASCII letters and digits, and every character beyond ASCII."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    def hashed(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))).otherwise(
            F.array().cast("array<long>"))
    return once(words, hashed)


def band_keys(shingles: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One hash per band of the smallest values of the shingles under ``rows`` hash functions."""
    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(seed))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)])
                     for b in range(bands)])


def step_of(length: int) -> int:
    return max(1, length // 8)


def template_table(spark: SparkSession, templates=TEMPLATES, shingle: int = SHINGLE) -> DataFrame:
    """(template, license, length, need array, keys array) of templates of ``shingle`` words or
    more; others cannot be found."""
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    words = spark.createDataFrame(rows, "template int, license string, text string").withColumn(
        "words", words_of(F.col("text")))
    return words.withColumn("length", F.size("words")).where(F.col("length") >= shingle).select(
        "template", "license", "length",
        F.array_distinct(shingles_of(F.col("words"), shingle)).alias("need")).withColumn(
        "keys", band_keys(F.col("need")))


def license_matches(docs: DataFrame, templates=TEMPLATES, *, key: str = "doc_id",
                    text: str = "text", shingle: int = SHINGLE, least: float = LEAST
                    ) -> DataFrame:
    """(key, template, license, start, share): best place of every template found in a row.

    ``start`` is the first word of the window, ``share`` the part of the template's shingles
    found.  Ties go to the earliest window.  NULL, empty and shorter texts have none; rows that
    share a key share findings, NULL keys have none; empty tables give no rows.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, shingle)
    # The templates are a fixed list in the code: their shingles are literals of the plan.
    fixed = known.select("length", "need").collect()
    wanted = sorted({s for r in fixed for s in r["need"]})
    if not wanted:
        wanted = [0]
    lengths = sorted({r["length"] for r in fixed})
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("k"), shingles_of(words_of(F.col(f"`{text}`")), shingle).alias("s"))
    near = rows.where(F.exists("s", lambda x: x.isin(wanted))).withColumn("hits", once(
        F.col("s"), lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                                       lambda i: F.get(s, i).isin(wanted))))

    def starts(length: int) -> Column:
        """Windows of one length that hold a hit, as (start, length, step)."""
        step, inner = step_of(length), length - shingle + 1
        # Each start is built for the hits it covers and then kept once.
        first = F.transform("hits", lambda h: F.transform(
            F.sequence(F.greatest(F.lit(0), F.ceil((h - (inner - 1)) / step).cast("int")),
                       F.floor(h / step).cast("int")), lambda g: g * step))
        return F.transform(F.array_distinct(F.flatten(first)), lambda a: F.struct(
            a.alias("start"), F.lit(length).alias("length"), F.lit(step).alias("step")))
    windows = near.select("k", "s", F.explode(F.concat(*map(starts, lengths))).alias("w")).select(
        "k", F.col("w.start").alias("start"), F.col("w.length").alias("length"),
        F.array_distinct(F.slice("s", F.col("w.start") + 1, F.col("w.length") - shingle + 1)
                         ).alias("inside"),
        F.array_distinct(F.slice(
            "s", F.greatest(F.lit(1), F.col("w.start") + 1 - F.col("w.step")),
            F.col("w.length") - shingle + 1 + 2 * F.col("w.step"))).alias("around"))
    keyed = windows.withColumn("window_keys", band_keys(F.col("inside")))
    # Bounded by the list in the code: a row per template.
    retrieved = keyed.join(F.broadcast(known), "length").where(
        F.arrays_overlap("window_keys", "keys"))
    share = F.size(F.array_intersect("need", "around")) / F.size("need")
    return retrieved.withColumn("share", share).where(F.col("share") >= least).groupBy(
        "k", "template", "license").agg(
        F.min(F.struct((-F.col("share")).alias("minus"), "start")).alias("best")).select(
        F.col("k").alias(key), "template", "license", F.col("best.start").alias("start"),
        (-F.col("best.minus")).alias("share"))


def with_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_licenses, licenses) of every row; ``licenses`` are sorted names, comma-joined."""
    found = license_matches(docs, key=key, text=text).groupBy(key).agg(
        F.array_sort(F.collect_set("license")).alias("names"))
    return docs.select(F.col(f"`{key}`")).join(found, key, "left").select(
        key, F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"))


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return with_licenses(table(spark, sf_dir, "documents"))
