"""Licence scans in DataFrame functions alone.

Every line of a file, and every window of 2 to LINES consecutive lines with at most WORDS words, is a sparse TF-IDF vector; the file's
licence is the template with the largest cosine to one of them. So headers, whose sentences may be wrapped, and licence files, by
their titles and grants, are found in files of any size. Files without a licence of their own take that of the licence file in their nearest ancestor directory, found
by joins of paths. The templates are fixed and few, so they are broadcast; nothing else is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import written

#: Least cosine of a licence, most lines and words of a window of several lines.
COSINE, LINES, WORDS = 0.6, 8, 120
#: Names of licence files (lower case, before a dot), stop words, which have no weight, notices in use.
FILE_NAMES = ("license", "licence", "copying", "unlicense")
COMMON = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "de", "for", "from", "in", "is", "it", "of", "on", "or", "our", "that", "the", "this", "to", "was", "with", "you")
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of"),
    ("MIT", "The MIT License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def content(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*COMMON))


def template_table(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(token, idf) and (template, license, token, share): a token's weight over the template's length, so that a cosine is a sum of products."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    counts = rows.select("template", "license", F.explode(content(tokens(F.col("text")))).alias("token")).groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("token").agg((F.log((1.0 + len(templates)) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = counts.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    size = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return idf, weighed.join(size, "template").select("template", "license", "token", (F.col("w") / F.col("size")).alias("share"))


def squared_shares(templates=TEMPLATES) -> dict[str, list[float]]:
    """For each word of a template its part of each template's squared length."""
    counts = [Counter(w for w in re.findall(r"[^\W_]+", text.lower()) if w not in COMMON) for _, text in templates]
    df = Counter(w for c in counts for w in c)
    weights = [{w: (n * (math.log((1 + len(templates)) / (1 + df[w])) + 1)) ** 2 for w, n in c.items()} for c in counts]
    return {w: [x.get(w, 0.0) / sum(x.values()) for x in weights] for w in sorted(df)}


def telling_words(shares: dict[str, list[float]], least: float = COSINE) -> list[str]:
    """Words of which every text with such a cosine to a template has one.

    A cosine is at most the length of the template's part that both share. So as long as the words left out, short ones first, make up less of
    each template, a text without the others stays below.
    """
    out, left = [0.0] * len(next(iter(shares.values()))), []
    for w in sorted(shares, key=lambda w: (len(w), w)):
        new = [o + x for o, x in zip(out, shares[w], strict=True)]
        if max(new) < least * least - 1e-9:
            out = new
        else:
            left.append(w)
    return left


def may_reach(words: Column, shares: dict[str, list[float]], least: float = COSINE) -> Column:
    """Whether words (without stop words) can have such a cosine to some template.

    Its square is at most the part of a template that both share, times the part of the words' own squared length that is shared. No
    word weighs more than one that no template has, so with n occurrences of shared words and d other words that differ the
    latter is at most n^2 / (n^2 + d).
    """
    table = F.create_map(*[x for w, v in shares.items() for x in (F.lit(w), F.array(*map(F.lit, v)))])
    none = F.array(*[F.lit(0.0)] * len(next(iter(shares.values()))))

    def judged(words: Column, shared: Column) -> Column:
        sums = F.array_max(F.aggregate(shared, none, lambda s, w: F.zip_with(s, F.element_at(table, w), lambda x, y: x + y)))
        n = F.size(F.filter(words, lambda w: F.array_contains(shared, w))).cast("double")
        d = F.size(F.array_distinct(words)) - F.size(shared)
        return sums * n * n / (n * n + d) >= least * least - 1e-9

    return _let(words, lambda ws: _let(F.array_intersect(ws, F.array(*map(F.lit, shares))), lambda shared: judged(ws, shared)))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once: a lambda would compute it again for every element."""
    return F.transform(F.array(value), then)[0]


def units(text: Column, touching: Column, telling: Column) -> Column:
    """The lines and windows of a text that may have a licence: an array of (p: first line, size: lines, words).

    A unit needs one of the telling words. A window whose first or last line has no word of a template is left out, for the window without
    that line has a larger cosine.
    """

    def line(words: Column) -> Column:
        touch = F.arrays_overlap(words, touching)
        return F.struct(words.alias("w"), touch.alias("touch"), F.when(touch, F.arrays_overlap(words, telling)).otherwise(False).alias("tell"), F.size(words).alias("n"))

    def windows(lines: Column) -> Column:
        def wanted(p: Column, size: Column) -> Column:
            some = F.slice(lines, p, size)
            short = (size == 1) | (F.aggregate(some, F.lit(0), lambda s, x: s + x.n) <= WORDS)
            return (p + size - 1 <= F.size(lines)) & F.coalesce(F.get(lines, p + size - 2).touch, F.lit(False)) & F.exists(some, lambda x: x.tell) & short

        def unit(p: Column, size: Column) -> Column:
            return F.struct(p.alias("p"), size.alias("size"), F.flatten(F.transform(F.slice(lines, p, size), lambda x: x.w)).alias("words"))

        def from_line(x: Column, i: Column) -> Column:
            sizes = F.filter(F.sequence(F.lit(1), F.lit(LINES)), lambda size: wanted(i + 1, size))
            return F.when(x.touch, F.transform(sizes, lambda size: unit(i + 1, size)))

        found = F.filter(F.transform(lines, from_line), lambda x: x.isNotNull())
        return F.when(F.exists(lines, lambda x: x.tell), F.flatten(found))

    return _let(F.transform(F.split(text, "\n"), lambda x: _let(tokens(x), line)), windows)


def own_licenses(files: DataFrame, key: str, text: str, least: float = COSINE, templates=TEMPLATES) -> DataFrame:
    """Rows (k, r, license, score) of files with a licence: key, hash of the text, the best template's licence (ties: the first name) and its cosine."""
    parts = squared_shares(templates)
    touching, telling = F.array(*map(F.lit, parts)), F.array(*map(F.lit, telling_words(parts, least)))
    own = files.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("r"), F.col(f"`{text}`").cast("string").alias("t"))
    found = own.select("k", "r", F.explode(units(F.col("t"), touching, telling)).alias("u"))
    some = found.select("k", "r", (F.col("u.p").cast("long") * (LINES + 1) + F.col("u.size")).alias("p"), content(F.col("u.words")).alias("words"))
    units_ = written(some.where(may_reach(F.col("words"), parts, least)).distinct(), "licences")
    idf, shares = template_table(files.sparkSession, templates)
    counts = units_.select("k", "r", "p", F.explode("words").alias("token")).groupBy("k", "r", "p", "token").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + len(templates))) + 1))
    dots = weighed.join(F.broadcast(shares), "token", "left")
    sums = dots.groupBy("k", "r", "p", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    sizes = weighed.groupBy("k", "r", "p").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    same = F.expr("d.k <=> s.k AND d.r = s.r AND d.p = s.p")
    scored = sums.where("template IS NOT NULL").alias("d").join(sizes.alias("s"), same).select("d.k", "d.r", "d.license", F.round(F.col("dot") / F.col("size"), 6).alias("score")).where(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license"))
    return scored.groupBy("k", "r").agg(best.alias("b")).select("k", "r", "b.license", (-F.col("b.minus")).alias("score"))


def directory(path: Column) -> Column:
    """The path before its last slash; empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", least: float = COSINE, templates=TEMPLATES) -> DataFrame:
    """Rows (key, path, license, score, origin, directory), one for each row of files.

    origin: 'file' for licence files, 'header' for other files with a licence of their own, 'inherited' for files whose licence is
    that of the nearest directory, their own included, with a licence file; null (with a null licence) for the rest.
    Of several licence files in a directory the best match counts, then the first name. Null texts have no licence of their own,
    null paths no directory. Other columns don't take part; repeated rows stay.
    """
    own = files.select(F.col(f"`{key}`").alias("k"), F.col(f"`{path}`").cast("string").alias("path"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("r"))
    found = own_licenses(files, key, text, least, templates).alias("b")
    named = F.regexp_extract(F.lower("path"), "([^/.]*)[^/]*$", 1).isin(*FILE_NAMES)
    marked = own.alias("a").join(found, F.expr("a.k <=> b.k AND a.r = b.r"), "left").select("a.k", "path", "license", "score", F.coalesce(named, F.lit(False)).alias("named"), directory(F.col("path")).alias("dir"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license"))
    licensed = marked.where("named AND license IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("at")).agg(best.alias("b"))
    # The ancestors of each directory once, however many files it has.
    dirs = marked.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth")).withColumn("at", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(licensed, "at").groupBy("dir").agg(F.max_by(F.struct("at", "b"), "depth").alias("n")).select(F.col("dir").alias("of"), F.col("n.at").alias("at"), F.col("n.b.license").alias("up"), (-F.col("n.b.minus")).alias("up_score"))
    joined = marked.join(nearest, F.expr("dir = of AND license IS NULL"), "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("named"), "file").otherwise("header")).when(F.col("up").isNotNull(), "inherited")
    return joined.select(F.col("k").alias(key), F.col("path"), F.coalesce("license", "up").alias("license"), F.coalesce("score", "up_score").alias("score"), origin.alias("origin"), F.when(F.col("license").isNull(), F.col("at")).alias("directory"))
