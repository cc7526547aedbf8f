"""License scan: sparse TF-IDF cosine of lines, paragraphs and whole files to license templates, and inheritance along directories.

Terms are weighted by how few templates hold them, a term in no template most; function words are no terms. Only a passage with one of the anchor terms
can reach the least cosine: anchors are chosen so that, for every template, all other terms together stay below it. So the
search for anchors, a pattern that Spark's own functions run over whole texts, loses nothing, and only lines with an anchor
are split into terms. A file without a license of its own gets that of the nearest directory above it that has a license
file, by joins on the paths. DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, others, unpacked
from sparkweft.staging import stage

LEAST_COSINE = 0.7
TERM = "[a-z0-9]+"

# Sentences by which works state their license, and openings of license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)


# Whole license texts, and titles of long ones, as they stand in license files.
FILE_TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
# Fixed value: names of files that hold a license.
LICENSE_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[._-].*)?$"

# A line without ASCII letters and digits, such as a blank one or one of comment marks, ends a paragraph.
_PARAGRAPH_END = r"\n[^A-Za-z0-9\n]*\n"

# Function words, which are no terms.
STOP_WORDS = frozenset(
    "a also an and any are as at be but by can do either for from has have if in is it its may met no not of on or other so such "
    "that the their them then there these this those to under use was were which will with without you your".split()
)


def terms(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS]


class Model:
    """Weights of template terms, unit template vectors and anchors, derived from the templates alone."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE):
        counts = [Counter(terms(text)) for _, text in templates]
        held = Counter(term for c in counts for term in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {term: math.log((1 + len(templates)) / (1 + n)) + 1 for term, n in held.items()}
        self.least, self.names = least, [name for name, _ in templates]
        self.vectors: list[dict[str, float]] = []
        anchors: set[str] = set()
        for c in counts:
            raw = {term: n * self.idf[term] for term, n in c.items()}
            length = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors.append({term: v / length for term, v in raw.items()})
        for vector in self.vectors:
            rest = 1.0 - sum(v * v for term, v in vector.items() if term in anchors)
            for term in sorted(vector, key=lambda t: (len(t) < 2, held[t] == 1 and len(t) < 4, -len(t), t)):
                if rest < (least - 1e-3) ** 2:
                    break
                if term not in anchors:
                    anchors.add(term)
                    rest -= vector[term] ** 2
        self.anchors = sorted(anchors)
        # Terms that a passage can't share with a template count for nothing, so it must hold this many of the template's.
        self.needed = []
        for vector in self.vectors:
            reached, masses = 0.0, sorted((v * v for v in vector.values()), reverse=True)
            self.needed.append(next(n for n, mass in enumerate(masses, 1) if (reached := reached + mass) >= (least - 1e-3) ** 2))


def _has_anchor(text: Column, model: Model) -> Column:
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(model.anchors) + r")(?![a-z0-9])"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _holds_enough(text: Column, model: Model) -> Column:
    """Whether a passage holds as many different terms of a template as the least cosine takes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1))

    def enough(held: Column) -> Column:
        each = [
            F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(vector))))) >= needed
            for vector, needed in zip(model.vectors, model.needed, strict=True)
        ]
        return reduce(lambda a, b: a | b, each)

    return F.exists(F.array(words), enough)  # one element, so that the words are found once


def _passages(text: Column, model: Model) -> Column:
    """Lines, paragraphs of several lines, and the whole, as structs of text and ``whole``; parts only with an anchor."""
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, _PARAGRAPH_END, -1)
    parts = F.concat(lines, F.filter(paragraphs, lambda part: part.contains("\n")))
    marked = F.transform(F.filter(parts, lambda part: _has_anchor(part, model)), lambda part: F.struct(part.alias("t"), F.lit(False).alias("whole")))
    return F.concat(marked, F.array(F.struct(text.alias("t"), F.lit(True).alias("whole"))))


def _openings(text: Column, model: Model) -> Column:
    """The whole and its first paragraph, either of which may show that a text is a license file."""
    first = F.get(F.split(F.regexp_replace(text, r"^[^A-Za-z0-9]+", ""), _PARAGRAPH_END, 2), F.lit(0))
    parts = F.filter(F.array(text, first), lambda part: _has_anchor(part, model))
    return F.transform(parts, lambda part: F.struct(part.alias("t"), F.lit(True).alias("whole")))


def direct_licenses(texts: DataFrame, model: Model, passages_of: Callable[[Column, Model], Column] = _passages) -> DataFrame:
    """For ``id`` and ``text``: the best template of each text with a passage that reaches the least cosine (``license``,
    ``cosine``), and whether the text as a whole does (``whole``). Passages are the lines, paragraphs and the whole."""
    spark = texts.sparkSession
    passages = texts.where(_has_anchor(F.col("text"), model)).select("id", F.posexplode(passages_of(F.col("text"), model)).alias("at", "p"))
    passages = passages.where(_holds_enough(F.col("p.t"), model)).repartition("id", "at")  # terms of a passage are then summed where they are found
    found = passages.select("id", "at", "p.whole", F.explode(F.regexp_extract_all(F.lower("p.t"), F.lit(f"({TERM})"), 1)).alias("term"))
    found = found.where(~F.col("term").isin(*sorted(STOP_WORDS)))
    counts = found.groupBy("id", "at", "whole", "term").agg(F.count(F.lit(1)).alias("n"))
    table = [(t, idf, [v.get(t, 0.0) for v in model.vectors]) for t, idf in sorted(model.idf.items())]
    known = F.broadcast(spark.createDataFrame(table, "term string, idf double, v array<double>"))
    weights = counts.join(known, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(model.unseen)))
    dots = [F.sum(F.col("w") * F.col("v")[i]).alias(f"d{i}") for i in range(len(model.vectors))]
    sums = weights.groupBy("id", "at", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), *dots)
    cosines = [
        F.struct(F.round(F.col(f"d{i}") / F.col("length"), 9).alias("cosine"), F.lit(-i).alias("order"), F.lit(name).alias("license"))
        for i, name in enumerate(model.names)
    ]
    near = sums.select("id", "whole", F.array_max(F.array(*cosines)).alias("best")).where(F.col("best.cosine") >= model.least)
    best = near.groupBy("id").agg(F.max("best").alias("best"), F.bool_or("whole").alias("whole"))
    return best.select("id", "best.license", "best.cosine", "whole")


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(files: DataFrame, owners: DataFrame) -> DataFrame:
    """``id``, ``license`` and ``origin`` from the nearest directory above each of ``files`` (id, path) among ``owners``
    (directory, license). Directories are looked up once each, not once per file."""
    above = F.transform(
        F.sequence(F.lit(0), F.size(F.split("directory", "/", -1)) - 1),
        lambda up: F.struct(up.alias("up"), F.array_join(F.slice(F.split("directory", "/", -1), 1, F.size(F.split("directory", "/", -1)) - up), "/").alias("owner")),
    )
    of = files.select("id", parent(F.col("path")).alias("directory"))
    directories = of.select("directory").distinct().select("directory", F.explode(above).alias("a")).select("directory", "a.*")
    top = directories.select("directory", F.lit(2**30).alias("up"), F.lit("").alias("owner")).distinct()
    met = directories.unionByName(top).join(owners.withColumnRenamed("directory", "owner"), "owner")
    nearest = met.groupBy("directory").agg(F.min_by(F.struct("license", F.col("owner").alias("origin")), "up").alias("n"))
    return of.join(stage(nearest), "directory").select("id", "n.license", "n.origin")


def scan_licenses(
    df: DataFrame, path: Column, text: str = "text", carry: Sequence[str] | None = None, model: Model | None = None,
    file_model: Model | None = None,
) -> DataFrame:
    """Every row with ``path``, ``license``, ``cosine``, ``evidence`` (``file``, ``header``, ``inherited`` or ``none``) and
    ``origin`` (the directory an inherited license comes from). ``carry`` names the columns to keep, all of them if None.

    A text is a license file and speaks for its directory if it is close as a whole to a template or a license text, if its first
    paragraph is close to the title of one, or if its name says so and a passage is close. Otherwise a line or paragraph that is
    close gives the text a header of its own. Of several license files in a directory the one with the greatest cosine, then the name that
    sorts first, counts. A null or empty text has no license of its own; a null path lies in no directory. Ties between
    templates go to the first. Repeated rows are scanned each. No rows give no rows. Columns named like results are replaced.
    """
    model, file_model = model or Model(), file_model or Model(FILE_TEMPLATES)
    names = [c for c in others(df, "path", "license", "cosine", "evidence", "origin") if carry is None or c in carry]
    held = F.struct(*[column(c) for c in names], F.lit(0).alias("__filler"))
    rows = stage(
        df.select(held.alias("row"), path.alias("path"), F.monotonically_increasing_id().alias("id"),
                  F.when(_has_anchor(column(text), model) | _has_anchor(column(text), file_model), column(text)).alias("text"))
    )
    texts = rows.where(F.col("text").isNotNull()).select("id", "text")
    found = direct_licenses(texts, model).withColumn("as_file", F.lit(False)).unionByName(
        direct_licenses(texts, file_model, _openings).withColumn("as_file", F.lit(True))
    )
    # What a text is as a file counts before what it says in passing.
    direct = stage(
        found.groupBy("id").agg(
            F.max_by(F.struct("license", "cosine"), F.col("as_file")).alias("best"), F.bool_or("whole").alias("whole")
        ).select("id", "best.*", "whole")
    )
    named = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_NAME), F.lit(False))
    known = stage(rows.drop("text").join(direct, "id", "left").withColumn("whole", F.col("whole") | (F.col("license").isNotNull() & named)))
    files = known.where("whole").where(F.col("path").isNotNull()).withColumn("directory", parent(F.col("path")))
    first = F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license").alias("license")))
    owners = stage(files.groupBy("directory").agg(first.alias("first")).select("directory", "first.license"))
    open_files = known.where(F.col("license").isNull() & F.col("path").isNotNull()).select("id", "path")
    came = inherited(open_files, owners).withColumnRenamed("license", "from_above")
    evidence = (
        F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header")
        .when(F.col("from_above").isNotNull(), "inherited").otherwise("none")
    )
    return known.join(came, "id", "left").select(
        *unpacked(names), "path", F.coalesce("license", "from_above").alias("license"), "cosine",
        evidence.alias("evidence"), "origin",
    )
