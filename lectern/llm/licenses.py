"""License scan: TF-IDF cosine of header lines and licence files to templates, then inheritance along directories.

All of it is DataFrame operations.  What is scored are a file's lines, its header blocks and the file as a whole.  A header
block is a run of two or more adjacent lines (a line without a term ends it, and comment marks aren't terms) of no more terms
than can reach the threshold if none is repeated; it counts where it is nearer to a template than the file's lines are, so
notices that are wrapped over lines are found.  A file as a whole is held, by damped term counts, against texts of licences.
A line or block is scored only if it has one of a template's heavy terms: the terms left out of those are so light together that a line without any heavy term stays
below the threshold, so this prefix filter loses nothing.  Term weights are inverse document frequencies over all
files, of the templates' terms; any other term counts as one that a tenth of the files have.  A file without a licence
of its own takes that of the nearest directory above it which holds a licence file.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Short notices by SPDX id (fixed values: the wording by which each licence is commonly declared).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: What licence files have at their top, for blocks of lines only.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)

#: Counts of the terms of whole licence texts, by SPDX id.
TEXTS: dict[str, dict[str, int]] = json.loads(Path(__file__).with_name("license_texts.json").read_text())

#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"
TERM = "[^a-z0-9]+"


def terms(text: str) -> Counter:
    return Counter(t for t in re.split(TERM, text.lower()) if t)


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies ln((1 + n) / (1 + df)) + 1 of the vocabulary over all files, and that of other terms."""
    own = files.select(F.explode(F.array_intersect(_terms(F.col("text")), F.lit(vocabulary))).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in own.collect()}  # at most one row for each term of the templates
    n = files.count()
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, math.log((1 + n) / (1 + n / 10)) + 1


def heavy_terms(vector: dict[str, float], threshold: float) -> list[str]:
    """The least terms, from the heaviest, so that lines with none of them have a cosine below the threshold."""
    norm = math.sqrt(sum(w * w for w in vector.values()))
    out, left = [], sorted(vector.items(), key=lambda x: (-x[1], x[0]))
    while left and math.sqrt(sum(w * w for _, w in left)) >= (threshold - 1e-9) * norm:
        out.append(left.pop(0)[0])
    return out


def _scored(name: str, vector: dict[str, float]) -> Column:
    """(minus the cosine of a line to a template, the template's licence)."""
    own = F.create_map(*[x for t, w in sorted(vector.items()) for x in (F.lit(t), F.lit(w))])
    dot = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(own, x["t"]), F.lit(0.0)))
    norm = math.sqrt(sum(w * w for _, w in sorted(vector.items())))
    return F.struct(F.round(-dot / (F.col("norm") * norm), 9).alias("score"), F.lit(name).alias("license"))


def _best(counted: DataFrame, tfidf: list[tuple[str, dict[str, float]]], idf: dict[str, float], other: float, threshold: float) -> DataFrame:
    """The rows of `counted` (file, total, n, all: terms) with own_terms and best, the nearest template, at or above the threshold."""
    # distinct terms with counts, as arrays: a line is bounded by its own row and is never spread by a shuffle
    own = counted.withColumn("own", F.array_distinct("all"))
    weight = F.create_map(*[x for t in sorted(idf) for x in (F.lit(t), F.lit(idf[t]))])
    pairs = F.transform("own", lambda t: F.struct(t.alias("t"), (F.size(F.filter("all", lambda x: x == t)) * F.coalesce(F.try_element_at(weight, t), F.lit(other))).alias("w")))
    rows = own.select("file", "total", "n", F.size("all").alias("own_terms"), pairs.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    return rows.select("file", "total", "n", "own_terms", F.least(*[_scored(name, v) for name, v in tfidf]).alias("best")).where(F.col("best.score") <= -threshold)


def _pattern(heavy: list[str]) -> str:
    return "(?i)(^|[^a-z0-9])(" + "|".join(map(re.escape, heavy)) + ")($|[^a-z0-9])"


def _blocks(rows: DataFrame, heavy: list[str], most: int) -> DataFrame:
    """file, total, n and all of each run of n adjacent lines, two or more, of `most` terms at most, that has a heavy term."""
    lines = rows.select("file", "total", F.transform(F.split("text", "\n"), lambda x: _terms(F.regexp_replace(x, r"(?i)^\s*(rem|dnl)\s", " "))).alias("lines"))
    sized = lines.withColumn("size", F.transform("lines", F.size))

    def fit(a: Column, x: Column) -> Column:
        go = a["go"] & (x > 0) & (a["sum"] + x <= most)
        return F.struct(F.when(go, a["sum"] + x).otherwise(a["sum"]).alias("sum"), F.when(go, a["n"] + 1).otherwise(a["n"]).alias("n"), go.alias("go"))

    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("go"))
    reach = sized.withColumn("reach", F.transform(F.sequence(F.lit(1), F.size("size")), lambda i: F.aggregate(F.slice("size", i, F.lit(most)), none, fit, lambda a: a["n"])))
    first = F.filter(F.sequence(F.lit(1), F.size("size")), lambda i: F.element_at("reach", i) >= 2)
    ahead = F.filter(F.transform(first, lambda i: F.slice("lines", i, F.element_at("reach", i))), lambda x: F.arrays_overlap(F.flatten(x), F.lit(heavy)))
    runs = reach.select("file", "total", F.explode(ahead).alias("run"))
    every = runs.select("file", "total", "run", F.explode(F.sequence(F.lit(2), F.size("run"))).alias("n"))
    return every.select("file", "total", "n", F.flatten(F.slice("run", F.lit(1), F.col("n"))).alias("all")).where(F.arrays_overlap("all", F.lit(heavy)))


def _whole(rows: DataFrame, texts: dict[str, dict[str, int]], idf: dict[str, float], other: float, threshold: float) -> DataFrame:
    """file and best of the files near a licence's whole text, by (1 + ln count) times term weights."""
    spark, idf_of = rows.sparkSession, lambda t: idf.get(t, other)
    damped = {name: {t: (1 + math.log(n)) * idf_of(t) for t, n in c.items()} for name, c in texts.items()}
    norm = {name: math.sqrt(sum(w * w for w in v.values())) for name, v in damped.items()}
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    near = spark.createDataFrame([(t, name, w / norm[name]) for name, v in damped.items() for t, w in v.items()], "term string, license string, share double")
    # each row by itself, also where a file has several
    apart = rows.select("file", "text", F.monotonically_increasing_id().alias("row"))
    counts = apart.select("file", "row", F.explode(_terms(F.col("text"))).alias("term")).groupBy("file", "row", "term").agg(F.count(F.lit(1)).alias("k"))
    w = counts.join(F.broadcast(known), "term", "left").select("file", "row", "term", ((1 + F.log("k")) * F.coalesce("idf", F.lit(other))).alias("w"))
    size = w.groupBy("file", "row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dot = w.join(F.broadcast(near), "term").groupBy("file", "row", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    return dot.join(size, ["file", "row"]).select("file", F.struct(F.round(-F.col("dot") / F.col("size"), 9).alias("score"), "license").alias("best")).where(F.col("best.score") <= -threshold)


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = 0.75, titles=TITLES, texts: dict[str, dict[str, int]] = TEXTS) -> DataFrame:
    """file, license and similarity of its best line, block or whole at or above the threshold, n_lines that are, and whether they are chiefly the file.

    files: columns file, path, text.  Ties go to lines before blocks, and to the licence id that comes first.  n_lines are
    the lines that reach the threshold by themselves or, if more, those of the best block where that is nearer.  Null
    texts have no lines.
    """
    vectors = [(name, terms(text)) for name, text in templates]
    vocabulary = sorted({t for _, v in vectors for t in v})
    idf, other = weights(files, vocabulary)
    tfidf = [(name, {t: n * idf[t] for t, n in v.items()}) for name, v in vectors]
    heavy = sorted({t for _, v in tfidf for t in heavy_terms(v, threshold)})
    pattern = _pattern(heavy)
    total = F.size(_terms(F.col("text"))).alias("total")
    lines = files.where(F.col("text").rlike(pattern)).select("file", total, F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern))).alias("of"))
    best = _best(lines.select("file", "total", F.lit(1).alias("n"), _terms(F.col("of")).alias("all")), tfidf, idf, other, threshold)
    by_line = best.groupBy("file").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n_lines"), (2 * F.sum("own_terms") >= F.max("total")).alias("chiefly"))
    # blocks, of titles as well
    longer = tfidf + [(name, {t: n * idf.get(t, other) for t, n in terms(text).items()}) for name, text in titles]
    heavy = sorted(set(heavy) | {t for _, v in longer for t in heavy_terms(v, threshold)})
    most = math.ceil(max(sum(terms(text).values()) for _, text in (*templates, *titles)) / threshold**2)
    rows = files.where(F.col("text").rlike(_pattern(heavy))).select("file", "text", total)
    block = _best(_blocks(rows, heavy, most), longer, idf, other, threshold)
    by_block = block.groupBy("file").agg(F.min(F.struct("best", "n")).alias("x"), F.max(2 * F.col("own_terms") >= F.col("total")).alias("chiefly")).select("file", F.col("x.best").alias("best"), F.col("x.n").cast("long").alias("n_lines"), "chiefly")
    by_file = _whole(rows, texts, idf, other, threshold).groupBy("file").agg(F.min("best").alias("best")).select("file", "best", F.lit(0).cast("long").alias("n_lines"), F.lit(True).alias("chiefly"))
    ranked = [x.select("file", F.struct(F.col("best.score").alias("score"), F.lit(k).alias("kind"), F.col("best.license").alias("license"), "n_lines", "chiefly").alias("x")) for k, x in enumerate((by_line, by_block, by_file))]
    out = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("file").agg(F.min("x").alias("x"), F.max("x.n_lines").alias("n"), F.max(F.col("x.chiefly") & (F.col("x.kind") != 1)).alias("chiefly"))
    by_lines = F.col("x.kind") == 0
    n_lines = F.when(by_lines, F.col("x.n_lines")).otherwise(F.col("n"))
    return out.select("file", F.col("x.license").alias("license"), (-F.col("x.score")).alias("similarity"), n_lines.alias("n_lines"), (F.col("chiefly") | F.col("x.chiefly")).alias("chiefly"))


def directory(path: Column) -> Column:
    """What stands before the last slash; the root, an empty string, without one."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit(""))


def inherit(files: DataFrame, found: DataFrame) -> DataFrame:
    """file, path, license, similarity, n_lines, how and from_path of all files.

    how: `own` (a line of the file), `inherited` (from the licence file in the nearest directory at or above the
    file's) or null (none).  Of several licence files in one directory the most similar counts, then the first path.
    """
    rows = files.select("file", "path", "is_license")
    own = rows.join(found, "file", "left")
    holders = own.where("(is_license OR chiefly) AND license IS NOT NULL AND path IS NOT NULL").select(directory(F.col("path")).alias("holder"), F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("from_path"), "license").alias("x")).groupBy("holder").agg(F.min("x").alias("x"))
    # each directory once, with itself and those above it by depth
    parts = F.split("dir", "/")
    above = rows.where("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct().select("dir", F.posexplode(F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>")))).alias("depth", "holder"))
    nearest = above.join(holders, "holder").groupBy("dir").agg(F.max_by("x", "depth").alias("up"))
    joined = own.withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "file",
        "path",
        F.coalesce("license", "up.license").alias("license"),
        F.coalesce("similarity", -F.col("up.s")).alias("similarity"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.when(has, F.lit("own")).when(F.col("up").isNotNull(), F.lit("inherited")).alias("how"),
        F.when(has, F.col("path")).otherwise(F.col("up.from_path")).alias("from_path"),
    )


def scan_licenses(docs: DataFrame, path: Column, templates=TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """doc_id and its licence (see `inherit`) of every document (doc_id, text) at a path.

    A licence file is named like one, or half of its words or more are in lines (or in one block) that declare a licence, or
    it is the text of one.  Repeated rows of a doc_id are one file with the lines of all and the least path; rows of null
    doc_id are one file for each path.  A null path is in no directory, a null text has no lines, and a very long text is
    scanned whole, line by line.  Other columns are left out.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("file"), path.alias("path"), F.col("text"))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    # null file numbers are kept apart from all others through the joins
    marked = rows.withColumn("is_license", named).withColumn("file", F.coalesce(F.col("file").cast("string"), F.concat(F.lit("null "), F.col("path")), F.lit("null")))
    files = marked.groupBy("file").agg(F.min("path").alias("path"), F.max("is_license").alias("is_license"))
    # what is found is read twice, for the files themselves and for their directories
    out = inherit(files, written(scan(marked, templates, threshold), "found"))
    return out.select(F.when(~F.col("file").startswith("null"), F.col("file").cast("long")).alias("doc_id"), "path", "license", "similarity", "n_lines", "how", "from_path")
