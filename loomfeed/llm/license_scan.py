"""License notices in documents, with DataFrame functions only.

A template of L words is looked for in windows of L + L // 4 words that start every L // 4
words (one more word at least), so every run of L words lies in a window. MinHash bands of
a window retrieve templates; a window that holds 0.8 of a template's shingles has a
similarity to it of at least 0.5, so with 32 bands of one row the probability that no
band agrees is at most 0.5 ** 32. A window whose shingles are in no template
cannot agree in any band; such windows are left out before their signatures are made.
Retrieved templates are verified by exact containment of word shingles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise

N = 5
BANDS, ROWS = 32, 1
#: At most so many templates, so many words each: what is broadcast is bounded by their product.
MAX_TEMPLATES, MAX_WORDS = 2000, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SPACES), lambda w: w != "")


def _shingle_strings(words: Column) -> Column:
    """The N-word shingles of a column of words, in order; none for fewer than N words."""
    n = F.size(words)
    return F.when(n >= N, F.transform(F.sequence(F.lit(1), F.greatest(n - N + 1, F.lit(1))), lambda i: F.concat_ws(" ", *(F.element_at(words, i + k) for k in range(N))))).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column) -> Column:
    """The band keys of a set of shingles."""
    def low(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))

    mins = [low(k) for k in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(F.lit(b), *mins[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """license, shingles (distinct strings), width and stride of the windows. Templates of fewer than N words match nothing."""
    if len(templates) > MAX_TEMPLATES or any(len(t.split()) > MAX_WORDS for _, t in templates):
        raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_WORDS} words")
    rows = []
    for name, text in templates:
        w = [x for x in re.split(SPACES, text.translate(str.maketrans(UPPER, LOWER))) if x]
        step = max(1, len(w) // 4)
        if len(w) >= N:
            rows.append((name, list(dict.fromkeys(" ".join(w[i : i + N]) for i in range(len(w) - N + 1))), len(w) + step, step))
    return spark.createDataFrame(rows, "license string, shingles array<string>, width int, stride int")


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, start_word for every license found in a document.

    containment: the largest share of the template's distinct shingles in one window;
    start_word: start of the first window (in words, from 0) with at least `least`. Null
    texts and texts of fewer than five words have no shingles; rows with a null id take no
    part; repeated rows of an id give one result; an empty table gives no rows; other
    columns are ignored. Very long texts are scanned whole.
    """
    spark = docs.sparkSession
    # a few rows, known on the driver; read back so that every later use shares one copy
    table = materialise(template_table(spark, templates).coalesce(1), "templates")
    bands = table.select("license", "width", "stride", F.col("shingles").alias("own"), F.explode(F.array_distinct(_bands(F.col("shingles")))).alias("band"))
    bands = materialise(bands, "template-bands")
    known = [r[0] for r in table.select(F.explode("shingles").alias("s")).select(F.xxhash64("s")).distinct().collect()]  # bounded as the templates are
    # explode(array(x)) makes x a column of its own: a filter on it is not computed again from the text
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.array(words_of(F.col(text_col)))).alias("w")).where(F.size("w") >= N)
    spots = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("w") - N + 1), lambda i: F.struct((i - 1).alias("i"), F.xxhash64(F.concat_ws(" ", *(F.element_at("w", i + k) for k in range(N)))).alias("h"))),
        lambda s: s["h"].isin(known) if known else F.lit(False),
    )
    found = rows.select("doc_id", "w", F.explode(F.array(spots)).alias("spots")).where(F.size("spots") > 0).withColumn("key", F.monotonically_increasing_id())
    found = materialise(found, "spots")  # documents that hold a template's shingle
    shingles = table.select(F.explode("shingles").alias("s"), "width", "stride").select(F.xxhash64("s").alias("h"), "width", "stride").distinct()
    at = found.select("key", F.explode("spots").alias("x")).select("key", "x.i", "x.h").join(F.broadcast(shingles), "h")
    lo = F.greatest(F.ceil((F.col("i") + N - F.col("width")) / F.col("stride")).cast("int"), F.lit(0))
    windows = at.select("key", "width", "stride", F.explode(F.sequence(lo, F.floor(F.col("i") / F.col("stride")).cast("int"))).alias("j")).distinct()
    windows = windows.join(found.select("key", "doc_id", "w"), "key").select("doc_id", "width", "stride", (F.col("j") * F.col("stride")).alias("start"), F.explode(F.array(F.slice("w", F.col("j") * F.col("stride") + 1, F.col("width")))).alias("w"))
    windows = materialise(windows.select("doc_id", "width", "stride", "start", _shingle_strings(F.col("w")).alias("has")), "windows").where(F.size("has") > 0)
    windows = windows.select("*", F.explode(F.array_distinct(_bands(F.col("has")))).alias("band"))
    met = windows.join(F.broadcast(bands), ["width", "stride", "band"]).groupBy("doc_id", "license", "start").agg(F.first("has").alias("has"), F.first("own").alias("own"))
    met = met.select("doc_id", "license", "start", (F.size(F.array_intersect("own", "has")) / F.size("own")).alias("c")).where(F.col("c") >= least)
    return met.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.min("start").cast("long").alias("start_word"))


def oracle_sql(templates=TEMPLATES, least: float = 0.8) -> str:
    """The same result by brute force over all windows, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates)
    words = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, {words} AS w FROM (VALUES {values}) AS v(license, text)),
t1 AS (SELECT license, len(w) + greatest(len(w) // 4, 1) AS width, greatest(len(w) // 4, 1) AS stride, list_distinct(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) AS own FROM t WHERE len(w) >= {N}),
t2 AS (SELECT license, width, stride, len(own) AS n, unnest(own) AS s FROM t1),
d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d1 AS (SELECT doc_id, w, unnest(range(0, len(w) - {N - 1})) AS i FROM d WHERE len(w) >= {N}),
d2 AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {N}], ' ') AS s FROM d1),
hit AS (SELECT doc_id, license, width, stride, n, s, i FROM d2 JOIN t2 USING (s)),
win AS (SELECT doc_id, license, n, s, stride, unnest(range(greatest(CAST(ceil((i + {N} - width) / CAST(stride AS DOUBLE)) AS BIGINT), 0), i // stride + 1)) AS j FROM hit),
c AS (SELECT doc_id, license, j * stride AS start, count(DISTINCT s) / CAST(max(n) AS DOUBLE) AS c FROM win GROUP BY 1, 2, 3)
SELECT doc_id, license, max(c) AS containment, CAST(min(start) AS BIGINT) AS start_word FROM c WHERE c >= {least} GROUP BY 1, 2"""
