import corpus_pipeline as C
from . import reference as R
from flockframe.llm import packing, quality, secrets, stages, wumanber

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents):
    docs = documents
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_copies", "benchmark_passages", "secret_spans", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in C.STAGES:
        docs = stages.written(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality":
            want = quality.quality(documents, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
            assert set(after) == {r["doc_id"] for r in want.collect()}
        if name == "near_copies":
            near = R.near({i: r["text"] for i, r in before.items()}, 80)
            assert set(after) == {i for i, (_, root) in near.items() if root == i}
        if name == "benchmark_passages":
            found = wumanber.decontaminate(spark.createDataFrame(list(before.values()), documents.schema), spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(after) == {r["doc_id"] for r in found.collect() if not r["contaminated"]}
        if name == "secret_spans":
            assert set(after) == set(before)
            assert all(r["text"] == before[i]["text"] or secrets.MASK in r["text"] for i, r in after.items())
        if name == "packing":
            assert docs.columns == packing._PIECES.names and set(after) == set(before)
        else:
            assert docs.columns == documents.columns
            before = after


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in C.STAGES:
            docs = stages.written(stage(spark, docs, SF))
            assert name == "packing" or docs.columns == columns


def test_one_row_of_each_group_stays(spark, odd):
    kept = [r["doc_id"] for r in stages.near_copies(spark, odd, SF).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15, 16, 17] and kept.count(None) == 2


def test_near_copies_link_at_four_fifths(spark):
    """Sets of shingles with a similarity from 0.80 to 0.85 are near copies to the pipeline."""
    texts = {}
    for k in range(8):
        words = [f"w{k}x{i}" for i in range(104)]  # 100 shingles
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words[:94 - k] + [f"v{k}x{i}" for i in range(10 + k)])
    want, strict = R.near(texts, 80), R.near(texts)
    kept = {i for i, (_, root) in want.items() if root == i}
    assert len(kept) < sum(root == i for i, (_, root) in strict.items()) and len(kept) > 8
    rows = [(i, t, "en", "src", len(t)) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stages.near_copies(spark, df, SF).collect()} == kept
