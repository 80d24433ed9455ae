"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies.

Words are runs of ASCII letters and digits in lower case; shingles are five words (a template of
fewer words is one shingle).  A template of m shingles is looked for in windows of 2 * s words that
begin at every multiple of s, s the power of two that is at least m: every stretch of m places lies
whole in one.  A window's shingles that no template has can't change what it contains of one, so they
are dropped first.  The rest give 32 minima, each a band: a template with 80 % of its shingles in a
window, even beside four times as many shingles of other templates, shares a band with it with
probability 1 - (1 - 0.16) ** 32 > 0.996; with no others it is 1 - 0.2 ** 32.  Templates so found
match if the window holds at least 0.8 of their shingles, counted exactly.

Null and empty texts match nothing.  Repeated rows (same id and text) give one result.  An empty
table gives an empty result.  Other columns are ignored.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BANDS, CONTAINMENT = 5, 32, 0.8
#: Template shingles that may be broadcast; more are joined by shuffle.
BROADCAST_SHINGLES = 50_000
# Public notices, the opening sentences of public licenses, and short licenses whole.
TEMPLATES = {
    "all_rights_reserved": "All rights reserved.",
    "apache_2_header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_2_notice": "Licensed under the Apache License, Version 2.0.",
    "bsd_clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_2_clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc_by_nc_4_notice": "Licensed under CC BY-NC 4.0.",
    "cc_by_sa_4_notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl_3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit_notice": "Released under the MIT License.",
    "mpl_2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of ``text``; some may be empty strings at its ends."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def _shingle(of: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(of, at + k) for k in range(size)])


def template_shingles(templates: DataFrame, size: int = WORDS) -> DataFrame:
    """template_id, its distinct shingle hashes ``have``, their number, and window step."""
    w = words(F.col("text"))
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(0), n - size), lambda i: _shingle(w, i, size))
    short = F.lit(None)
    for k in range(size - 1, 0, -1):
        short = F.when(n == k, F.array(_shingle(w, F.lit(0), k))).otherwise(short)
    have = F.array_distinct(F.when(n >= size, long).otherwise(short))
    out = templates.where(F.length(w[0]) > 0).select("template_id", have.alias("have"))
    step = F.pow(F.lit(2), F.ceil(F.log2(F.size("have").cast("double")))).cast("int")
    return out.withColumns({"shingles": F.size("have"), "step": step})


def scan(docs: DataFrame, templates: DataFrame, size: int = WORDS, bands: int = BANDS, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, template_id, matched (the most shingles in a window), shingles and first_word (of the first
    window's matches), for every document and template (template_id, text) that match.

    The templates' words, a bounded table, are brought to the driver once; documents are never shuffled
    as texts, only the places where a template's shingle stands.
    """
    listed = templates.select("template_id", F.coalesce("text", F.lit("")).alias("text"))
    table = template_shingles(listed, size)
    split = [r["w"] for r in listed.select(words(F.col("text")).alias("w")).collect()]
    total = table.agg(F.sum("shingles").alias("n")).first()["n"] or 0
    sizes = sorted({min(size, len(w)) for w in split if w[0]}) or [1]
    vocabulary = sorted({x for w in split for x in w})
    hint = F.broadcast if total <= BROADCAST_SHINGLES else (lambda df: df)
    # Places whose first words all are template words; others can't begin a template's shingle.
    of = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rid"), words(F.col(text_col)).alias("w")).where("w is not null")
    last = F.size("w") - sizes[0]

    def likely(i: Column) -> Column:
        out = F.get("w", i).isin(vocabulary)
        for k in range(1, sizes[0]):
            out = out & F.get("w", i + k).isin(vocabulary)
        return out

    starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), likely))
    hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array(*[F.when(F.size("w") >= i + k, _shingle(F.col("w"), i, k)) for k in sizes]).alias("hs")))
    places = of.select("id", "rid", F.explode(hashed).alias("p")).select("id", "rid", "p.at", F.explode("p.hs").alias("h"))
    shingles = table.select("step", F.explode("have").alias("h")).distinct()
    found = places.join(hint(shingles), "h")
    seen = found.withColumn("window", F.explode(F.array(F.floor(F.col("at") / F.col("step")), F.floor(F.col("at") / F.col("step")) - 1))).where("window >= 0")
    minima = [F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(bands)]
    windows = seen.groupBy("id", "rid", "step", "window").agg(F.collect_set("h").alias("hs"), F.min("at").alias("first_word"), *minima)

    def least(band: int) -> Column:
        return F.array_min(F.transform("have", lambda h: F.xxhash64(h, F.lit(band)))).alias(f"m{band}")

    signed = table.select("template_id", "step", *[least(k) for k in range(bands)])

    def banded(df: DataFrame, *kept: str) -> DataFrame:
        return df.select(*kept, F.posexplode(F.array(*[f"m{k}" for k in range(bands)])).alias("band", "least"))

    hits = banded(windows, "id", "rid", "step", "window", "hs", "first_word").join(hint(banded(signed, "template_id", "step")), ["step", "band", "least"])
    hits = hits.groupBy("id", "rid", "step", "window", "template_id").agg(F.first("hs").alias("hs"), F.first("first_word").alias("first_word"))
    checked = hits.join(hint(table.select("template_id", "have", "shingles")), "template_id").withColumn("matched", F.size(F.array_intersect("hs", "have")))
    good = checked.where(F.col("matched") >= F.lit(containment) * F.col("shingles"))
    out = good.groupBy("id", "rid", "template_id").agg(F.max("matched").alias("matched"), F.max("shingles").alias("shingles"), F.min("first_word").alias("first_word"))
    return out.select(F.col("id").alias(id_col), "template_id", "matched", "shingles", "first_word")
