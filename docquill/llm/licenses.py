"""License scans by sparse TF-IDF cosine to templates, with directory inheritance [native].

1. Every line with a marker word opens header windows of 1, 3, 10 and 30
   lines. Whole licence files are such windows too: their first lines hold a
   marker.
2. Words are weighted by their count times the inverse document frequency
   among the templates. Windows meet templates through an equi-join on words;
   dot products over vector lengths give the cosine. A window's best template
   counts if its cosine is ``MIN_COSINE`` or more.
3. Files without an own license take that of the nearest ancestor directory
   (their own included) which holds a licence file. The join is between
   directories and ancestors, then between files and directories, so a
   directory with a third of all files costs one row in the first join.

With ``in_prose`` the words around each marker are windows too, inside a line
or across lines up to the end of the text: for every template the window that
lies as the template's own words do around its marker. It is compared with the
templates of its size. A marked line then has the best license of each marker,
and that of its header windows if no marker scores as high.

Defined results: a null or empty text has no license of its own; null paths
inherit nothing; rows that agree in path and text are one file, each gets its
result; of several licence files in a directory the first by path counts, of
equal cosines the first template by name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions._util import bind, explode_rows
from docquill.llm.common import read, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKER = r"licen[cs]e|copyright|spdx|redistribution and use|permission is hereby granted|public domain"
WINDOWS = (1, 3, 10, 30)
MIN_COSINE = 0.6
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"

# License id and notice texts in common use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
                     "holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


# Close variants, tags and sentences, beside TEMPLATES: license id, names in notices.
NAMES = [
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
]
TAGS = sorted({k for k, _ in TEMPLATES + NAMES})
MORE_TEMPLATES = (
    [(k, f"{how} the {x}") for k, x in NAMES for how in ("under", "under the terms of")]
    + [(k, f"Licensed under {x}.") for k, x in (("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"))]
    + [(k, f"This work is licensed under a {x}.") for k, x in NAMES if "ShareAlike" in x]
    + [(k, f"SPDX-License-Identifier: {k}{more}") for k in TAGS for more in ("", "-only", "-or-later")[:3 if "GPL" in k else 1]])
MARKER_WORD = r"licen[cs]e|copyright|spdx|^(redistribution|permission|public)$"


def _low(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_low(text), F.lit("([a-z0-9]+)"), F.lit(1))


def template_vectors(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, float]:
    """(t, license, w, weight, idf, length): a row per word of each template; and the idf of unknown words.

    idf is ln((1 + templates) / (1 + templates with the word)) + 1.
    """
    import math

    t = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(templates)], "t int, license string, text string")
    tf = t.select("t", "license", F.explode(_words(F.col("text"))).alias("w")).groupBy("t", "license", "w").count()
    n = len(templates)
    df = tf.groupBy("w").agg((F.log((1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    v = tf.join(df, "w").withColumn("weight", F.col("count") * F.col("idf"))
    length = v.groupBy("t").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return v.join(length, "t").select("t", "license", "w", "weight", "idf", "length"), math.log(1 + n) + 1


def headers(files: DataFrame) -> DataFrame:
    """(path, th, line, lines, words): header windows of files (path, th, text)."""
    marked = files.where(F.regexp_like(_low("text"), F.lit(MARKER)))
    found = marked.select("path", "th", F.split("text", "\n").alias("all"))
    spans = bind(F.col("all"), lambda a: F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                                                  lambda s: F.regexp_like(_low(s["x"]), F.lit(MARKER))))
    each = explode_rows(found, spans, ["path", "th", "all"], value="s")
    sizes = F.array(*[F.lit(w) for w in WINDOWS])
    win = each.select("path", "th", "all", F.col("s.i").alias("line"), F.explode(sizes).alias("lines"))
    return win.where((F.col("lines") == 1) | (F.col("line") + F.col("lines") <= F.size("all"))).select(
        "path", "th", "line", "lines", F.array_join(F.slice("all", F.col("line") + 1, F.col("lines")), "\n").alias("x"))


def shapes(templates) -> list[tuple[int, int]]:
    """(words before the marker, words in all) for every marker word of every template."""
    import re

    split = [re.findall("[a-z0-9]+", x.lower()) for _, x in templates]
    return sorted({(i, len(w)) for w in split for i, x in enumerate(w) if re.search(MARKER_WORD, x)})


def prose_matches(files: DataFrame, templates, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, th, line, license, cosine): the best template of the windows of words around each marker."""
    vectors, unknown = template_vectors(files.sparkSession, templates)
    size = F.broadcast(vectors.groupBy("t").agg(F.sum(F.round(F.col("weight") / F.col("idf"))).cast("int").alias("k")))
    vectors = F.broadcast(vectors.join(size, "t"))
    idf = F.broadcast(vectors.select("w", "idf").distinct())
    shape = shapes(templates)
    far = max(k for _, k in shape)
    marked = files.where(F.regexp_like(_low("text"), F.lit(MARKER))).select("path", "th", "text").distinct()
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.transform(_words(x), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    spots = bind(F.flatten(lines), lambda ws: F.transform(
        F.filter(F.transform(ws, lambda x, i: F.struct(x["w"].alias("w"), x["line"].alias("line"), i.alias("i"))),
                 lambda x: F.regexp_like(x["w"], F.lit(MARKER_WORD))),
        lambda x: F.struct(x["line"].alias("line"), x["i"].alias("i"), F.least(x["i"], F.lit(far)).alias("at"),
                           F.slice(ws, F.greatest(x["i"] - far, F.lit(0)) + 1, F.lit(2 * far))["w"].alias("near"))))
    spot = saved(explode_rows(marked, spots, ["path", "th"], value="s").select("path", "th", "s.*"))
    key = ["path", "th", "line", "i"]
    # Equal surroundings are scored once.
    spot = spot.withColumn("g", F.xxhash64("at", "near"))
    once = spot.groupBy("g").agg(F.first("at").alias("at"), F.first("near").alias("near"))
    each = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in shape])
    win = once.select("g", "at", "near", F.explode(each).alias("x")).where("x.b <= at").select(
        "g", F.col("x.b").alias("b"), F.col("x.k").alias("k"), F.slice("near", F.col("at") - F.col("x.b") + 1, F.col("x.k")).alias("words"))
    tf = win.select("g", "b", "k", F.explode("words").alias("w")).groupBy("g", "b", "k", "w").count()
    tf = tf.join(idf, "w", "left").withColumn("weight", F.col("count") * F.coalesce("idf", F.lit(unknown))).drop("idf")
    own = tf.groupBy("g", "b", "k").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own"))
    dots = (tf.join(vectors.select("w", "t", "license", "k", F.col("weight").alias("tw"), "length"), ["w", "k"])
            .groupBy("g", "b", "k", "t", "license", "length").agg(F.sum(F.col("weight") * F.col("tw")).alias("dot")))
    cos = dots.join(own, ["g", "b", "k"]).withColumn("cosine", F.round(F.col("dot") / F.col("own") / F.col("length"), 6))
    # Of equal cosines the longer template says more.
    best = cos.groupBy("g").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("k")).alias("k"), "license")).alias("m"))
    best = best.select("g", F.col("m.license").alias("license"), (-F.col("m.c")).alias("cosine")).where(F.col("cosine") >= min_cosine)
    found = spot.select("g", *key).join(best, "g")
    return found.groupBy("path", "th", "line", "license").agg(F.max("cosine").alias("cosine"))


def all_matches(files: DataFrame, templates, min_cosine: float) -> DataFrame:
    """The matches of header windows and of words; a line's header match counts if no word window of the line scores as high."""
    words, head = saved(prose_matches(files, templates, min_cosine)), matches(files, templates, min_cosine)
    on = ["path", "th", "line"]
    top = words.groupBy(*on).agg(F.max("cosine").alias("top")).select(*[F.col(c).alias("_" + c) for c in on], "top")
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("th") == F.col("_th")) & (F.col("line") == F.col("_line"))
    more = head.join(top, same, "left").where("top is null or cosine > top").select(words.columns)
    return words.unionByName(more).groupBy(*on, "license").agg(F.max("cosine").alias("cosine"))


def matches(files: DataFrame, templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, th, line, license, cosine): the best template of each marked line of files (path, th, text)."""
    vectors, unknown = template_vectors(files.sparkSession, templates)
    vectors = F.broadcast(vectors)          # as large as the list of templates given by the caller
    idf = F.broadcast(vectors.select("w", "idf").distinct())
    key = ["path", "th", "line", "lines"]
    h = headers(files).withColumn("_k", F.xxhash64(*key))
    tf = h.select("_k", *key, F.explode(_words(F.col("x"))).alias("w")).groupBy("_k", *key, "w").count()
    tf = tf.join(idf, "w", "left").withColumn("weight", F.col("count") * F.coalesce("idf", F.lit(unknown))).drop("idf")
    lengths = tf.groupBy("_k", *key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own"))
    dots = (tf.join(vectors.select("w", "t", "license", F.col("weight").alias("tw"), "length"), "w")
            .groupBy("_k", *key, "t", "license", "length").agg(F.sum(F.col("weight") * F.col("tw")).alias("dot")))
    on = ["_k", *key[2:]]
    cos = dots.join(lengths.select(*on, "own"), on).withColumn("cosine", F.round(F.col("dot") / F.col("own") / F.col("length"), 6))
    best = cos.groupBy("path", "th", "line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("m"))
    return best.select("path", "th", "line", F.col("m.license").alias("license"), (-F.col("m.c")).alias("cosine")).where(
        F.col("cosine") >= min_cosine)


def scan(files: DataFrame, is_license_file: Column | None = None, path_col: str = "path", text_col: str = "text",
         templates=TEMPLATES, min_cosine: float = MIN_COSINE, in_prose: bool = False) -> DataFrame:
    """One row per file: (path, th, licenses, n_matches, cosine, inherited, license_dir).

    ``licenses``: own ids, sorted and comma-joined, or the inherited one.
    ``is_license_file``: which files speak for their directory, over the columns
    path and first_line (first matched line, null if none); by name if not given.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    f = files.select(F.col(path_col).alias("path"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = saved((all_matches if in_prose else matches)(f, templates, min_cosine))
    own = found.groupBy("path", "th").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("own"), F.count(F.lit(1)).alias("n_matches"),
        F.max("cosine").alias("cosine"), F.min(F.struct("line", "license")).alias("first"))
    own = own.withColumn("first_line", F.col("first.line")).withColumn("first_license", F.col("first.license"))
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).when(c.isNotNull(), F.lit(""))
    speaks = is_license_file if is_license_file is not None else F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(LICENSE_NAME))
    stated = (own.where(speaks & F.col("path").isNotNull())
              .groupBy(parent(F.col("path")).alias("above")).agg(F.min(F.struct("path", "first_license")).alias("m"))
              .select("above", F.col("m.first_license").alias("dir_license")))
    # Every directory against its ancestors: one row per directory and level.
    slim = f.select("path", "th", parent(F.col("path")).alias("dir"))
    dirs = slim.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = dirs.select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(levels)).alias("depth", "above"))
    near = (up.join(stated, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("m"))
            .select("dir", F.col("m.above").alias("above"), F.col("m.dir_license").alias("dir_license")))
    o = own.select(F.col("path").alias("p"), F.col("th").alias("t"), "own", "n_matches", "cosine")
    out = slim.join(o, slim["path"].eqNullSafe(o["p"]) & (slim["th"] == o["t"]), "left").join(near, "dir", "left")
    inherits = F.col("own").isNull() & F.col("dir_license").isNotNull()
    return out.select("path", "th", F.coalesce("own", "dir_license").alias("licenses"),
                      F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
                      inherits.alias("inherited"), F.when(inherits, F.col("above")).alias("license_dir"))


def query(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Documents as files ``source/doc_id div 1000/doc_id.txt``; a document that opens with its license speaks for its directory."""
    docs = read(spark, sf_dir, "documents")
    path = F.format_string("%s/%d/%d.txt", F.col("source"), F.expr("doc_id div 1000"), F.col("doc_id"))
    out = scan(docs.select(path.alias("path"), "text"), is_license_file=F.col("first_line") == 0, **how)
    doc_id = F.regexp_extract("path", r"([0-9-]+)\.txt$", 1).try_cast("bigint")
    return out.select(doc_id.alias("doc_id"), "path", "licenses", "n_matches", "cosine", "inherited", "license_dir")


def query_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query with windows of words and all templates."""
    return query(spark, sf_dir, templates=TEMPLATES + MORE_TEMPLATES, in_prose=True)


def oracle(templates=TEMPLATES) -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, k, x.replace("'", "''")) for i, (k, x) in enumerate(templates))
    low = "translate({}, '%s', '%s')" % (UPPER, LOWER)
    sizes = ", ".join(f"({w})" for w in WINDOWS)
    return f"""
WITH tpl(t, license, text) AS (VALUES {rows}),
ttf AS (SELECT t, license, w, count(*) AS n FROM (SELECT t, license, unnest(regexp_extract_all({low.format('text')}, '[a-z0-9]+')) AS w FROM tpl) GROUP BY ALL),
idf AS (SELECT w, ln((1.0 + {len(templates)}) / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY w),
tv AS (SELECT t, license, w, n * idf AS weight, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY t)) AS length FROM ttf JOIN idf USING (w)),
f AS (SELECT doc_id, source || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
l AS (SELECT path, string_split(text, chr(10)) AS a, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM f
      WHERE regexp_matches({low.format('text')}, '{MARKER}')),
h AS (SELECT path, line, n, array_to_string(a[line + 1:line + n], chr(10)) AS x FROM l, (VALUES {sizes}) AS s(n)
      WHERE regexp_matches({low.format('a[line + 1]')}, '{MARKER}') AND (n = 1 OR line + n <= len(a))),
tf AS (SELECT path, line, n, w, count(*) AS c FROM (SELECT path, line, n, unnest(regexp_extract_all({low.format('x')}, '[a-z0-9]+')) AS w FROM h) GROUP BY ALL),
wt AS (SELECT tf.*, c * coalesce(idf, ln(1 + {len(templates)}) + 1) AS weight FROM tf LEFT JOIN idf USING (w)),
own AS (SELECT path, line, n, sqrt(sum(weight * weight)) AS length FROM wt GROUP BY ALL),
cos AS (SELECT path, line, license, round(sum(wt.weight * tv.weight) / any_value(own.length) / any_value(tv.length), 6) AS c
        FROM wt JOIN tv USING (w) JOIN own USING (path, line, n) GROUP BY path, line, n, t, license),
best AS (SELECT path, line, license, c FROM (
           SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY c DESC, license) AS r FROM cos) WHERE r = 1 AND c >= {MIN_COSINE}),
mine AS (SELECT path, string_agg(DISTINCT license, ',' ORDER BY license) AS own, count(*) AS n_matches, max(c) AS cosine,
                min(line) AS first_line, arg_min(license, line) AS first_license FROM best GROUP BY path),
stated AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(first_license, path) AS lic FROM mine WHERE first_line = 0 GROUP BY 1)
SELECT f.doc_id, f.path, coalesce(own, lic) AS licenses, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches,
       coalesce(cosine, 0.0) AS cosine, (own IS NULL AND lic IS NOT NULL) AS inherited,
       CASE WHEN own IS NULL AND lic IS NOT NULL THEN regexp_replace(f.path, '/[^/]*$', '') END AS license_dir
FROM f LEFT JOIN mine USING (path) LEFT JOIN stated ON stated.dir = regexp_replace(f.path, '/[^/]*$', '')
"""


ORACLE = oracle()
