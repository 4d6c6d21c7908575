import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flockframe.llm import licenses as L

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "# plain code\nprint(1)"), (3, "a/b/c/d.py", None),
    (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3.\n" + "filler words here " * 60),
    (5, "a/b/c/e/f.py", "nothing"), (6, "z/y.py", "intro. Licensed under CC BY-NC 4.0. more"), (7, "z/w.py", ""),
    (8, "z/q/long.py", "word " * 100 + "end. All rights reserved. " + "other " * 100), (9, None, "text"), (None, "a/b/x.py", "no id"),
    (2, "a/b/x.py", "# plain code\nprint(1)"), (10, "README", "Licensed under the Apache License, Version 2.0"), (11, "k/n.py", "just a license of mine"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, p, t, 5, "x", True) for i, p, t in FILES]
    return spark.createDataFrame(rows, "doc_id long, path string, text string, score int, name string, license boolean").repartition(3)


def words(text):
    return re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", (text or "").lower())


def slow(files):
    """Licences by plain dictionaries: all statements against all templates."""
    n = len(files)
    df = Counter(w for _, _, t in files for w in set(words(t)))
    weight = lambda w: math.log((n + 1) / (df[w] + 1)) + 1

    def vector(text):
        v = {w: k * weight(w) for w, k in Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}
    templates = [(name, vector(t)) for name, t in L.TEMPLATES]
    out = []
    for i, path, text in files:
        text, found, statements = text or "", [], 0
        joined = re.sub("\n", " ", re.sub(r"\n\s*\n", "\x01", text))
        pieces = [(p, True) for p in re.sub(r"([.!?;])\s+", "\\1\n", text).split("\n")]
        pieces += [(p, False) for p in [*re.sub(r"([.!?;])\s+", "\\1\x01", joined).split("\x01"), text]]
        for part, statement in pieces:
            v = vector(part)
            s, name = min((-round(sum(v[w] * t.get(w, 0) for w in v), 6), name) for name, t in templates)
            if -s >= L.LEAST:
                found.append((s, name))
                statements += statement
        out.append((i, path or "", statements, min(found)[1] if found else None))
    return out


def test_own_licences_as_computed_slowly(files):
    got = [(r["doc_id"], r["path"], r["n_statements"], r["license"]) for r in L.scan(files).collect()]
    assert sorted(got, key=str) == sorted(slow(FILES), key=str)


def test_nearest_ancestor(files):
    got = {(r["doc_id"], r["path"]): (r["is_license_file"], r["inherited"], r["inherited_from"], r["distance"], r["effective"])
           for r in L.scan(files).collect()}
    assert got[2, "a/b/x.py"] == (False, "MIT", "a", 1, "MIT") == got[None, "a/b/x.py"]
    assert got[3, "a/b/c/d.py"] == (False, "GPL-3.0", "a/b/c", 0, "GPL-3.0")
    assert got[5, "a/b/c/e/f.py"] == (False, "GPL-3.0", "a/b/c", 1, "GPL-3.0")
    assert got[1, "a/LICENSE"] == (True, "MIT", "a", 0, "MIT") and got[4, "a/b/c/COPYING"][0]
    assert got[7, "z/w.py"] == (False, "CC-BY-NC-4.0", "z", 0, "CC-BY-NC-4.0")
    assert got[8, "z/q/long.py"][0] is False and got[8, "z/q/long.py"][4] == "proprietary"
    assert got[9, ""][4] == got[10, "README"][4] == "Apache-2.0" and got[11, "k/n.py"][4] == "Apache-2.0"


def test_documents_with_a_licence_line(documents):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "GNU General Public License, version 3.": "GPL-3.0"}
    want = F.lit(None)
    for line, name in lines.items():
        want = F.when(F.col("text").contains(line), name).otherwise(want)
    want = {r[0]: r[1] for r in documents.select("doc_id", want).collect()}
    assert {r["doc_id"]: r["license"] for r in L.scan(documents.withColumn("path", F.lit("x"))).collect()} == want


HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

def run():
    return 1
"""


def test_headers_and_whole_licences(spark):
    """A wrapped header, and licence texts of any length under any name."""
    whole = {name: text for name, text in L.TEMPLATES if len(text) > 600}
    apache = "Apache License\nVersion 2.0, January 2004\n" + "terms and conditions for use reproduction and distribution\n" * 300 + (
        "APPENDIX: How to apply.\n\n   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file")
    texts = [(1, "a/run.py", HEADER + "".join(f"def f{i}(a{i}):\n    return b{i}\n" for i in range(60))), (2, "b/terms", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + whole["MIT"].replace(", ", ",\n")),
             (3, "b/x.py", "x"), (4, "c/text.md", whole["ISC"]), (5, "c/d/y", "y"), (6, "e/LICENSE", apache), (7, "e/z", "z")]
    texts += [(100 + i, f"f/{i}", f"plain words {i} of the program and the software") for i in range(40)]
    got = {r["doc_id"]: (r["is_license_file"], r["effective"]) for r in L.scan(spark.createDataFrame(texts, "doc_id long, path string, text string")).collect()}
    assert got[1] == (False, "GPL-3.0") and got[2] == (True, "MIT") and got[3] == (False, "MIT")
    assert got[4] == (True, "ISC") and got[5] == (False, "ISC") and got[6] == (True, "Apache-2.0") and got[7] == (False, "Apache-2.0")
    assert got[100] == (False, None)


def test_a_common_word_beside_a_statement_weighs_little_at_any_size(spark):
    for n in (30, 3000):
        texts = spark.range(n).selectExpr("id AS doc_id", "concat('d/', id) AS path", "concat('project word', id % 700) AS text")
        more = spark.createDataFrame([(n, "e/x", "This project is released under the MIT License")], "doc_id long, path string, text string")
        assert L.scan(texts.union(more)).filter(f"doc_id = {n}").first()["license"] == "MIT"


def test_empty_table(none):
    assert L.scan(none.withColumn("path", F.lit("a/b"))).collect() == []


def test_a_line_that_most_files_have(spark):
    """However common its words, a statement is found."""
    texts = [(i, f"d/{i}.py", "Licensed under CC BY-NC 4.0." if i % 3 else "the end of this work") for i in range(60)]
    got = {r["doc_id"]: r["license"] for r in L.scan(spark.createDataFrame(texts, "doc_id long, path string, text string")).collect()}
    assert got == {i: "CC-BY-NC-4.0" if i % 3 else None for i in range(60)}


def test_words_of_most_texts_are_no_anchors(spark):
    """Else most texts are compared whole: ``the`` is heavy in long templates by its number alone."""
    texts = spark.range(2000).selectExpr("id AS doc_id", "concat('the word', id, ' of the end') AS text")
    known, counts = L.template_table(spark), L.term_counts(texts)
    found = L.anchors(known, counts, 2000, L.LEAST)
    assert found and not {"the", "of"} & set(found)
    idf = {r["term"]: math.log(2001 / (r["n_docs"] + 1)) + 1 for r in counts.filter("term in ('the', 'of')").collect()}
    for words in (r["words"] for r in known.collect()):  # what is left of each template is too short
        square = {t: (words.count(t) * idf.get(t, math.log(2001) + 1)) ** 2 for t in words}
        assert sum(w for t, w in square.items() if t not in found) < L.LEAST ** 2 * sum(square.values())
