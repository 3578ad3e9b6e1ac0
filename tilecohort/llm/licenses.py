"""License scans, in DataFrame operations only.

A header is a line that holds a licence marker, alone or with the line after it; a
licence file is a text under a name like LICENSE or COPYING, or one that is a licence as
a whole. Both are compared with templates by the cosine of sparse TF-IDF vectors: the
terms of all units are exploded once, joined with the templates' terms, and norm and
products are summed in one aggregation. A document without a licence of its own takes
that of the nearest directory above it that has a licence file, by a join on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Notices of common licences, with their SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Titles of licence texts.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"), ("Artistic-1.0", "The Artistic License"),
]
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
# Whole texts of the short licences, as published.
WHOLE = [
    ("MIT", f"""MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"""ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND. For more information, please refer to https://unlicense.org"""),
]
#: A text without any of these holds no header.
MARKER = r"(?i)licen[cs]e|copyright|public domain|permission|redistribution|spdx"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Names of licence files.
FILE_NAME = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[.-].*)?$"
#: Cosines from which a header, and a text as a whole, counts.
HEADER, FILE = 0.6, 0.75
TEMPLATES = TEMPLATES + TITLES + WHOLE


def term_weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[str, float, list[float]]], float]:
    """(rows (term, idf, weight in each template's vector of length 1), idf of a term that no template has)."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(t for b in bags for t in b)
    n = len(bags)
    idf = {t: 1 + math.log((1 + n) / (1 + d)) for t, d in df.items()}
    norms = [math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in b.items())) for b in bags]
    return [(t, x, [b[t] * x / m for b, m in zip(bags, norms)]) for t, x in sorted(idf.items())], 1 + math.log(1 + n)


def cosines(units: DataFrame, keys: list[str], text: str, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Best template of each unit: keys, license, score (rounded to 6 places; ties to the first licence by name).

    keys name a unit and hold no null. Units without a term are left out.
    """
    rows, other = term_weights(templates)
    known = units.sparkSession.createDataFrame(rows, "term string, idf double, w array<double>")  # as large as the templates
    terms = units.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(known), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    dots = [F.sum(F.col("x") * F.col("w")[i]).alias(f"d{i}") for i in range(len(templates))]
    summed = weighed.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("square"), *dots)
    scored = F.array(*[F.struct((-F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.sqrt("square"), 6)).alias("s"), F.lit(name).alias("license")) for i, (name, _) in enumerate(templates)])
    return summed.select(*keys, F.array_min(scored).alias("b")).select(*keys, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan(files: DataFrame, path: str = "path", doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licence of every file.

    Returns doc_id, path, own_license and own_score (the best header that reaches HEADER, or text that reaches FILE), license
    (own, else inherited, else null) and licensed_by (its own path, or the directory whose licence file
    it takes). Files are told apart by (path, doc_id); repeated rows give one row, a null path has no
    directory and inherits nothing, a null or empty text has no licence of its own. Ties go to the higher
    score, then the licence's name. An empty table gives an empty result; other columns aren't read.
    """
    rows = files.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text")).withColumn("file", F.xxhash64("doc_id", "path", F.col("doc_id").isNull(), F.col("path").isNull()))
    marked = rows.filter(F.col("text").rlike(MARKER))
    # units: marked lines, those with the next line that holds anything, and the text itself (number -1)
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(MARKER))
    own_lines = F.transform(at, lambda i: F.struct((i * 2).alias("unit"), F.get("lines", i).alias("t")))
    pairs = F.transform(F.filter(at, lambda i: i + 1 < F.size("lines")), lambda i: F.struct((i * 2 + 1).alias("unit"), F.concat_ws(" ", F.get("lines", i), F.get("lines", i + 1)).alias("t")))
    whole_text = F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("t")))
    units = marked.withColumn("lines", lines).select("file", F.explode(F.concat(own_lines, pairs, whole_text)).alias("u")).select("file", "u.unit", "u.t")
    found = written(cosines(units, ["file", "unit"], "t", templates).filter(F.col("score") >= HEADER), "cosines")
    top = lambda: F.min(F.struct((-F.col("score")).alias("s"), "license"))
    best = found.filter("unit >= 0 OR score >= %s" % FILE).groupBy("file").agg(top().alias("b"), F.bool_or((F.col("unit") < 0) & (F.col("score") >= FILE)).alias("is_whole")).select("file", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), "is_whole")

    keyed = rows.select("doc_id", "path", "file").distinct().withColumn("dir", directory(F.col("path")))
    with_own = keyed.join(best, "file", "left")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME)
    given = with_own.filter(F.col("path").isNotNull() & F.col("own_license").isNotNull() & (F.col("is_whole") | named))
    held = given.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("b")).select("above", F.col("b.license").alias("given"))
    # the nearest ancestor is found once for each directory, not for each file
    directories = rows.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = directories.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above"))
    nearest = ancestors.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n")).select("dir", F.col("n.above").alias("above"), F.col("n.given").alias("given"))

    out = with_own.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("above")).alias("licensed_by"))


def document_path(source: Column, doc_id: Column) -> Column:
    """Where a document of the table lies: its source, then directories of 512 and of 32 documents, the first of which is its licence file."""
    name = F.when(doc_id % 32 == 0, F.lit("LICENSE")).otherwise(doc_id.cast("string"))
    return F.concat_ws("/", F.lit(""), F.coalesce(source, F.lit("unknown")), F.floor(doc_id / 512).cast("string"), F.floor(doc_id / 32).cast("string"), name)
