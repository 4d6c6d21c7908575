"""Licences of files: sparse TF-IDF cosine of their statements to templates, and inheritance down directories.

DataFrame and SQL functions only. A text falls into statements (lines, and sentences within them), sentences across line ends
(headers are often wrapped) and itself as a whole; those with a term without which no template can be near enough are
compared with all templates. A file without a licence of its own takes that of the nearest ancestor directory that holds a
licence file: one that is named so, or whose whole text is near a template.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint
from . import text as X

#: Licence names and the statements by which files name them. Fixed values, from the licences' public texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
    # headers and whole licences
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
     "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
     "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
     "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
     "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
#: Least cosine of a statement with its template.
LEAST = 0.7
#: Names of licence files.
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([.-].*)?$"
#: Kinds of parts of a text.
STATEMENT, SENTENCE, WHOLE = 0, 1, 2
_WORD = "[a-z0-9]+(?:[.][0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """name, number, words of each template."""
    rows = json.dumps([{"name": n, "number": k, "text": t} for k, (n, t) in enumerate(templates)])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<name:string,number:int,text:string>>")).alias("t"))
    return checkpoint(table.select("t.name", "t.number", _words(F.col("t.text")).alias("words")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_docs): in how many documents each term occurs, over all terms and documents."""
    return docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))


def _idf(n_docs, n: int) -> Column:
    return F.log((F.lit(float(n)) + 1) / (F.coalesce(n_docs, F.lit(0)) + 1)) + 1


def anchors(templates: DataFrame, counts: DataFrame, n: int, least: float) -> list[str]:
    """The rarest terms of each template, until the rest of its unit vector is shorter than ``least``: a statement without any
    of them cannot reach that cosine. Words that most texts have stay in the rest, however heavy their number makes them. What comes to the driver are the templates' own terms, a few hundred whatever the corpus.
    """
    lists = [r[0] for r in templates.select("words").collect()]
    terms = sorted({t for words in lists for t in words})
    met = dict(counts.filter(F.col("term").isin(terms)).collect())
    idf = {t: math.log((n + 1) / (met.get(t, 0) + 1)) + 1 for t in terms}
    found = set()
    for words in lists:
        squares = sorted((idf[t], (words.count(t) * idf[t]) ** 2, t) for t in set(words))
        total, rest = sum(w for _, w, _ in squares), 0.0
        for _, w, t in squares:
            rest += w
            if rest >= 0.999 * least * least * total:
                found.add(t)
    return sorted(found)


def parts(anchors: list[str]) -> Column:
    """(kind, part) of ``text``: its lines and the sentences within them, its sentences across line ends, and itself; those
    that have one of the anchors."""
    anchor = "(?i)\\b(?:" + "|".join(t.replace(".", "[.]") for t in anchors) + ")\\b"
    lines = F.split(F.regexp_replace("text", r"([.!?;])\s+", "$1\n"), "\n")
    joined = F.regexp_replace(F.regexp_replace("text", r"\n\s*\n", "\x01"), "\n", " ")
    sentences = F.split(F.regexp_replace(joined, r"([.!?;])\s+", "$1\x01"), "\x01")

    def of(kind, found):
        return F.transform(F.filter(found, lambda p: p.rlike(anchor)), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("kind"), F.col("text").alias("part")))
    return F.when(F.col("text").rlike(anchor), F.concat(of(STATEMENT, lines), of(SENTENCE, sentences), whole))


def matched(parts: DataFrame, templates: DataFrame, counts: DataFrame, n: int, least: float = LEAST) -> DataFrame:
    """uid, kind, place, name, score: the template nearest to each part, where the cosine is ``least`` or more.

    Weights are term frequency times ln((n + 1) / (documents with the term + 1)) + 1. Ties go to the first name.
    """
    keys = ["uid", "kind", "place"]

    def frequencies(df, keys):
        return checkpoint(df.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf")))

    def norms(weights, keys, name):
        return weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))

    own, rows = frequencies(templates, ["name", "number"]), frequencies(parts, keys)
    needed = own.select("term").union(rows.select("term")).distinct()
    idf = checkpoint(needed.join(counts, "term", "left").select("term", _idf(F.col("n_docs"), n).alias("idf")))
    own, rows = (df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")) for df in (own, rows))
    own = checkpoint(own.join(norms(own, ["number"], "norm"), "number").select(
        "name", "number", "term", (F.col("w") / F.col("norm")).alias("tw")))
    rows = checkpoint(rows.select(*keys, "term", "w"))
    dots = rows.join(own, "term").groupBy(*keys, "number", "name").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms(rows, keys, "norm"), keys).select(
        *keys, "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.select(*keys, F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """dir, inherited, inherited_from, distance of every directory of ``files`` (dir, license, score, is_license_file).

    Directories, not files, meet their ancestors: one row for each level. A directory with several
    licence files takes the one of highest score, then first name.
    """
    holders = (files.filter("is_license_file and license is not null").groupBy("dir")
               .agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
               .select(F.col("dir").alias("above"), F.col("b.license").alias("inherited")))
    levels = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda k: F.array_join(F.slice(levels, F.lit(1), k), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))  # the root first
    every = files.select("dir").distinct().select("dir", (F.size(above) - 1).alias("depth"), F.posexplode(above).alias("k", "above"))
    near = every.join(checkpoint(holders), "above").groupBy("dir").agg(
        F.max(F.struct("k", "above", "inherited", "depth")).alias("b"))
    return near.select("dir", "b.inherited", F.col("b.above").alias("inherited_from"),
                       (F.col("b.depth") - F.col("b.k")).alias("distance"))


def scan(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """One row for each file: doc_id, path, n_statements, license, score, is_license_file, inherited, inherited_from,
    distance, effective.

    ``files``: doc_id, path, text. ``license`` is the name that a part of the file is nearest to, ``n_statements`` counts
    lines and sentences within them; ``inherited`` is the licence of the nearest ancestor directory (its own first) with a licence
    file, ``distance`` levels up; ``effective`` the first of the two that is known. A licence file is named so and has a licence, or
    its whole text is near a template, whatever its length.

    Null and empty texts have no statement. A null path is the root directory's nameless file. Repeated rows each get
    their answer; a null id stays null. Other columns are not looked at; an empty table gives no rows.
    """
    rows = X.documents(files, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"))
    known = template_table(files.sparkSession, templates)
    counts, n = checkpoint(term_counts(rows)), rows.count()
    # one pass over the texts takes what is needed of them, and gives each row its number
    thin = checkpoint(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "path",
                                  parts(anchors(known, counts, n, least)).alias("parts")))
    split = thin.select("uid", F.posexplode("parts").alias("place", "p")).select("uid", "p.kind", "place", _words(F.col("p.part")).alias("words"))
    found = checkpoint(matched(split, known, counts, n, least))
    best = found.groupBy("uid").agg(F.count_if(F.col("kind") == STATEMENT).alias("n_statements"),
                                    F.max(F.col("kind") == WHOLE).alias("near"), F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    best = best.select("uid", "n_statements", "near", F.col("b.name").alias("license"), (-F.col("b.s")).alias("score"))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE)
    whole = checkpoint(thin.drop("parts").join(best, "uid", "left").select(
        "doc_id", "path", directory(F.col("path")).alias("dir"), F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        "license", "score", (F.col("license").isNotNull() & (named | F.col("near"))).alias("is_license_file")))
    return whole.join(checkpoint(inherited(whole)), "dir", "left").select(
        "doc_id", "path", "n_statements", "license", "score", "is_license_file", "inherited", "inherited_from", "distance",
        F.coalesce("license", "inherited").alias("effective"))
