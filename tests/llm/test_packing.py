import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flockframe.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.default_vocabulary())


def check(pieces, docs, tokenizer, length):
    """Every id in one piece, right checksums, sequences gapless and within length; returns the padding."""
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in docs)
    by_seq, ids = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        ids[r["doc_id"], r["doc_tokens"]].append(r)
    sizes = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in docs)
    assert {k: sum(r["length"] for r in v) for k, v in ids.items()} == {k: k[1] * n for k, n in sizes.items()}
    known = {(i, len(x)): x for i, t in docs for x in [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")]}
    for r in pieces:
        x = known[r["doc_id"], r["doc_tokens"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(x.tobytes()) == r["ids_crc32"]
    pad = 0
    for seq in by_seq.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return pad + 0 * len(want)


def test_round_trip(documents, texts, tokenizer):
    assert check(P.pack(documents).collect(), list(texts.items()), tokenizer, 2048) == 0


@pytest.mark.parametrize("range_tokens", [P.RANGE_TOKENS, 50])
def test_odd_rows(odd, tokenizer, range_tokens):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert check(P.pack(odd, length=64, range_tokens=range_tokens).collect(), docs, tokenizer, 64) == 0


def test_empty_table(none):
    assert P.pack(none).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["It's I'LL", "é ́x", "<|endoftext|>a", "Σ ΟΔΟΣ ς", "a\x1cb\x85c　d"]), max_size=5))
def test_encoder_gives_the_tokenizer_s_ids(texts):
    enc = P.encoder(P.default_vocabulary())
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_curve_visits_neighbours():
    axes = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = P.hilbert(axes, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(axes[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_lie_close():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 300), rng.integers(500, 1000, 300)
    docs = [a, np.append(a[:-5], b[:5]), b, np.append(b[:-5], a[:5])]
    keys = P.curve_keys(np.concatenate(docs), np.repeat(np.arange(4), 300), 4)
    order = np.argsort(keys).tolist()
    assert abs(order.index(0) - order.index(1)) == 1 and abs(order.index(2) - order.index(3)) == 1
