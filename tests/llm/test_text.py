import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from . import reference as R
from flockframe.llm import text as X

TEXT = st.text(st.sampled_from("aAbZ09 \t\n\x0b\x1c.!é中\U0001f600"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = X.utf8(pa.array(texts))
    for inside, pattern in ((X.SPACED, R.spaced), (X.ALNUM, R.alnum)):
        low = X.LOWER[data]
        starts, ends, first = X.word_spans(low, offsets, inside)
        found = [bytes(low[a:b]).decode() for a, b in zip(starts, ends)]
        assert [found[a:b] for a, b in zip(first, first[1:])] == [pattern(t) for t in texts]
        hashes, _ = X.words(data, offsets, inside)
        assert len(set(hashes.tolist())) == len(set(found))


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=2, max_size=5))
def test_shingle_sets_overlap_as_sets_of_words_do(texts):
    sets = list(X.shingle_sets(*X.words(*X.utf8(pa.array(texts))), 5))
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(R.shingles(s) & R.shingles(t))


def test_chunks_keep_all_rows_and_never_split_a_text():
    texts = ["a" * 10, None, "b" * 5000, "", "c" * 30]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], names=["id", "text"]).slice(1)
    got = [(r, bytes(d[a:b]).decode()) for rows, d, o in X.chunks([batch], limit=40)
           for r, a, b in zip(rows.column("id").to_pylist(), o, o[1:])]
    assert got == [(1, ""), (2, "b" * 5000), (3, ""), (4, "c" * 30)]
