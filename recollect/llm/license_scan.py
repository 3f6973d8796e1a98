"""License scan, with DataFrame functions only.

A text is its words (runs of letters and digits, in lower case). Windows of
STEP five-word shingles overlap by four words and cover all shingles. A window's
MinHash has BANDS bands of one row: with one of STEP shingles in common a band
collides with probability 1/STEP at least, so all BANDS bands miss with
probability (1 - 1/STEP)**BANDS, under 0.0001 for the settings here, and a
window that lies inside a notice always collides with the template's window at
the same offset. A window that collides retrieves templates; then the share of
the template's shingles that the words around the window contain is counted
exactly, and MATCH or more is a hit.

The templates are a bounded table, so the index of their bands is broadcast. A
band's value is its least shingle's hash in another guise (mixed with the band's
constant, which can be undone), so the index is kept by that shingle: a window is
looked up by its own STEP shingles, and only for windows that hold a key of the
index are the bands computed and compared. A window without any key collides in no
band, so this retrieves what comparing all bands of all windows would, at a tenth of
the time. The texts are scanned once.

Edge cases: null and empty texts, and texts of fewer than five words, have no
shingles and no hits; very long texts are scanned whole, a window at a time;
repeated rows of a document give its best hit once, and of several texts with one
doc_id the best hit of any; a null doc_id is a document; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: License notices by SPDX name.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
#: Words of a shingle; shingles of a window; bands; share of a template's shingles that is a hit.
K, STEP, BANDS, MATCH = 5, 4, 32, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle(w: Column, at: Column) -> Column:
    """The shingle of words that begins at index at (from 0), null where words run out."""
    return F.when(F.get(w, at + K - 1).isNotNull(), F.xxhash64(*(F.get(w, at + i) for i in range(K))))


def mix(k: int) -> int:
    """The constant of a band, as a signed number of 64 bits."""
    m = (0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)
    return m - (1 << 64) if m >> 63 else m


def bands(h: list[Column]) -> Column:
    """One MinHash row a band: the least of the window's shingle hashes, each mixed with the band's constant."""
    return F.array(*(F.least(*(x.bitwiseXOR(F.lit(mix(k))) for x in h)) for k in range(BANDS)))


def templates(spark: SparkSession, notices: list[tuple[str, str]] | DataFrame = NOTICES) -> DataFrame:
    """(license, template, shingles, w): notices, as a list or a table (license, notice) of bounded size, with their distinct shingles; those of under five words say nothing."""
    listed = [(r.license, r.notice) for r in notices.select("license", "notice").distinct().orderBy("license", "notice").collect()] if isinstance(notices, DataFrame) else notices
    rows = spark.createDataFrame([(i, *n) for i, n in enumerate(listed)], "template int, license string, notice string")
    rows = rows.withColumn("w", words(F.coalesce("notice", F.lit("")))).where(F.size("w") >= K)
    return rows.withColumn("shingles", all_shingles(F.col("w")))


def all_shingles(w: Column) -> Column:
    n = F.size(w) - K + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(K)), " ")))).otherwise(F.array().cast("array<string>"))


def scan(documents: DataFrame, notices: list[tuple[str, str]] | DataFrame = NOTICES) -> DataFrame:
    """(doc_id, template, license, word_at, containment): the best hit of each template in each document."""
    spark = documents.sparkSession
    known = templates(spark, notices)
    around = known.agg(F.coalesce(F.max(F.size("w")), F.lit(0))).first()[0]  # words around a window that may belong to the notice
    at = known.withColumn("at", F.explode(F.sequence(F.lit(1 - STEP), F.size("w") - K)))
    for i in range(STEP):
        at = at.withColumn(f"h{i}", F.when(F.col("at") + i >= 0, shingle(F.col("w"), F.col("at") + i)))
    h = [F.col(f"h{i}") for i in range(STEP)]
    index = at.select("template", "license", "shingles", F.posexplode(bands(h)).alias("band", "value")).where("value is not null").distinct()
    keys = sorted({r.value ^ mix(r.band) for r in index.select("band", "value").distinct().collect()})  # bounded by the templates

    rows = documents.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0)), F.lit(STEP))).alias("at"))
    # inline() of one row computes the shingles once; without it every band would hash the words again
    rows = rows.select("doc_id", "w", "at", F.inline(F.array(F.struct(*(shingle(F.col("w"), F.col("at") + i).alias(f"h{i}") for i in range(STEP))))))
    begin = F.greatest(F.col("at") - around, F.lit(0))
    near = F.slice("w", begin + 1, F.lit(2 * around + STEP + K - 1))
    listed = ", ".join(f"{k}L" if k > -(1 << 63) else "bigint(-9223372036854775808)" for k in keys)
    rows = rows.where(" OR ".join(f"h{i} IN ({listed})" for i in range(STEP)) if keys else "false").select("doc_id", "at", near.alias("near"), F.posexplode(bands(h)).alias("band", "value"))
    # one row a window and template; windows of different texts stay apart even if doc_id and place are the same
    found = rows.join(F.broadcast(index), ["band", "value"]).dropDuplicates(["doc_id", "at", "template", "near"])
    share = F.size(F.array_intersect("shingles", all_shingles(F.col("near")))) / F.size("shingles")
    found = found.select("doc_id", "template", "license", "at", share.alias("containment")).where(F.col("containment") >= MATCH)
    best = found.groupBy("doc_id", "template", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("best"))
    return best.select("doc_id", "template", "license", (-F.col("best.back")).cast("long").alias("word_at"), F.col("best.containment").alias("containment"))


def op1_license_scan(documents: DataFrame) -> DataFrame:
    """doc_id, license, n_templates, containment: the licenses that each document names."""
    found = scan(documents)
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_templates"), F.round(F.max("containment"), 4).alias("containment"))


def oracle() -> str:
    """Exact containment of every notice in every document, by brute force over shingles."""
    lines = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(NOTICES))
    cut = "list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])"
    return f"""
WITH notice(template, license, notice) AS (VALUES {lines}),
t AS (SELECT template, license, {cut} AS s FROM (SELECT template, license, regexp_extract_all(lower(notice), '[a-z0-9]+') AS w FROM notice)),
d AS (SELECT doc_id, {cut} AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
x AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM d),
y AS (SELECT template, license, len(s) AS n, unnest(s) AS g FROM t),
c AS (SELECT doc_id, template, license, count(DISTINCT g) / n AS containment FROM x JOIN y USING (g) GROUP BY doc_id, template, license, n)
SELECT doc_id, license, count(*) AS n_templates, round(max(containment), 4) AS containment FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
"""
