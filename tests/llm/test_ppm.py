import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flockframe.llm import ppm
from flockframe.llm import text as X


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def slow_bits(learned: dict[str, str], lang: str, text: str) -> float:
    """Code length with contexts counted in dictionaries."""
    counts = Counter()
    for name, t in learned.items():
        data = b"\n" * ppm.ORDER + t.lower().encode()
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts[name, data[i - k:i], data[i]] += 1
    bits, data = 0.0, b"\n" * ppm.ORDER + text.lower().encode()
    for i in range(ppm.ORDER, len(data)):
        for k in range(ppm.ORDER, -1, -1):
            seen = {b: n for (name, c, b), n in counts.items() if name == lang and c == data[i - k:i]}
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(whole / seen[data[i]])
                break
            bits += math.log2(whole / len(seen)) if seen else 0
        else:
            bits += 8
    return bits


def test_code_lengths_as_counted_slowly():
    learned = {"a": "abra cadabra abba", "b": "tick tock tack tick"}
    grams, langs = [], []
    for k, t in enumerate(learned.values()):
        code, _ = ppm._grams(*X.utf8(pa.array([t])))
        grams.append(code)
        langs += [k] * len(code)
    model = ppm.Model(list(learned), np.array(langs), np.concatenate(grams), np.ones(len(langs)))
    texts = ["abra", "tack abba zoo", "Tock", "q"]
    code, text = ppm._grams(*X.utf8(pa.array(texts)))
    bits = model.lengths(code)
    for k, lang in enumerate(learned):
        got = np.bincount(text, bits[:, k])
        assert got == pytest.approx([slow_bits(learned, lang, t) for t in texts], rel=1e-5)


def test_odd_rows(odd):
    got = ppm.languages(odd.withColumn("lang", F.when(F.col("doc_id") < 8, F.lit("en")).when(F.col("doc_id") == 12, F.lit("xx")))).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 14))
    assert by[15]["lang_pred"] != "und" and by[1]["lang_pred"] in ("en", "xx")


def test_nothing_to_learn(odd, none):
    assert {r["lang_pred"] for r in ppm.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert ppm.languages(none).collect() == []


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 5000, 900).astype(np.uint64))
    table = ppm.Table(keys, np.zeros((len(keys), 1)))
    asked = np.arange(5000, dtype=np.uint64)
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (table.find(asked) == want).all()
