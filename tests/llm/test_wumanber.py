import hashlib

import pytest

from . import reference as R
from flockframe.llm import wumanber as W

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again, and again!"), (2, "one"), (3, "two words"), (4, None), (5, ""),
         (2, "one"), (None, "vital ñandú"), (10, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"), (11, "absent passage")]


def expected(text, items):
    w = R.alnum(text)
    hit, found = set(), set()
    for name, t in items:
        v = R.alnum(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if v else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == v[i:i + k]:
                    hit.update(range(j, j + k))
                    found.add(name)
    names = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("pack_bytes", [1 << 20, 30])
def test_odd_rows(odd, items, pack_bytes):
    got = W.decontaminate(odd, items, pack_bytes).collect()
    want = [(r["doc_id"], *expected(r["text"], ITEMS)) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_windows_across_segments(spark):
    passage = " ".join(f"x{i}" for i in range(1, 12))
    texts = [(n, "filler " * n + passage + " filler" * (300 - n) + " " + passage) for n in (0, 1, 100, 117, 118, 127, 128, 129, 200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["n_hit"] for r in W.decontaminate(df, items).collect()} == {22}


def test_filter_keeps_clean_rows_with_all_columns(odd, items):
    kept = W.without_passages(odd, items)
    assert kept.schema == odd.schema
    want = [r for r in odd.collect() if not expected(r["text"], ITEMS)[4]]
    assert sorted(kept.collect(), key=str) == sorted(want, key=str)


def test_empty_tables(odd, none, items):
    assert W.decontaminate(none, items).collect() == []
    assert not any(r["contaminated"] for r in W.decontaminate(odd, items.limit(0)).collect())
