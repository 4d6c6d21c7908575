import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flockframe.llm import matching as M


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(M.default_vocabulary())


def one_by_one(sizes, length):
    """The sequences, as sorted lists of lengths, that the rules give when pieces are taken singly."""
    large = sorted((n for n in sizes if 3 * n > length), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        fits = [b for b in large if a + b <= length]
        if fits:
            large.remove(fits[0])
        bins.append([a, *fits[:1]])
    for s in sorted((n for n in sizes if 3 * n <= length), reverse=True):
        room = [b for b in bins if length - sum(b) >= s]
        if room:
            min(room, key=lambda b: length - sum(b)).append(s)
        else:
            bins.append([s])
    return bins


def contents(kinds):
    out = []
    for kind, number in kinds:
        out += [sorted(n for n, each in kind for _ in range(each))] * number
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda length: st.tuples(st.just(length), st.lists(st.integers(1, length), max_size=60))))
def test_plan_is_the_rules_taken_singly(drawn):
    length, sizes = drawn
    kinds = M.plan(collections.Counter(sizes), length)
    got = contents(kinds)
    assert sorted(n for b in got for n in b) == sorted(sizes) and all(sum(b) <= length for b in got)
    want = one_by_one(sizes, length)
    assert len(got) == len(want)
    assert sorted(map(sum, got)) == sorted(map(sum, want))
    rank = collections.Counter()
    places = M.dealt(kinds)
    filled = collections.defaultdict(list)
    for n in sizes:
        at = max(k for k in range(len(places["length"])) if (places["length"][k], places["first"][k]) <= (n, rank[n]))
        inside, slot = divmod(rank[n] - places["first"][at], places["each"][at])
        filled[places["sequence"][at] + inside].append((places["offset"][at] + slot * n, n))
        rank[n] += 1
    assert sorted(sorted(n for _, n in v) for v in filled.values()) == sorted(got)
    for v in filled.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]


def test_matching_pairs_all_it_can():
    """As many pairs of large pieces as any matching has (by trying all), and few sequences for many pieces."""
    def most(sizes):
        if not sizes:
            return 0
        a, rest = sizes[0], sizes[1:]
        return max([most(rest), *(1 + most(rest[:k] + rest[k + 1:]) for k, b in enumerate(rest) if a + b <= 30)])
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(11, 30) for _ in range(rng.randint(1, 8))]
        assert len(contents(M.plan(collections.Counter(sizes), 30))) == len(sizes) - most(sizes)
    sizes = [rng.randint(1, 1024) for _ in range(5000)] + [7] * 200
    assert len(contents(M.plan(collections.Counter(sizes)))) <= 1.02 * -(-sum(sizes) // 1024)
    assert len(M.plan({n: 10 ** 9 + n for n in range(1, 1025)})) < 10_000  # kinds do not grow with the pieces


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(df, docs, tokenizer, length):
    """Each piece's ids and place; returns the number of sequences."""
    rows = df.collect()
    want = collections.Counter()
    for i, t in docs:
        x = ids(tokenizer, t)
        cuts = [0, *range(len(x) % length or length, len(x) + 1, length)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in filled.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length
    sizes = [r["length"] for r in rows]
    assert len(filled) == sum(n == length for n in sizes) + len(one_by_one([n for n in sizes if n < length], length))
    return len(filled)


def test_documents(documents, texts, tokenizer):
    n = check(M.pack(documents), list(texts.items()), tokenizer, 1024)
    assert n <= 1.05 * sum(len(ids(tokenizer, t)) for t in texts.values()) / 1024


@pytest.mark.parametrize("length", [1024, 16])
def test_odd_rows(odd, tokenizer, length):
    check(M.pack(odd, length=length), [tuple(r) for r in odd.select("doc_id", "text").collect()], tokenizer, length)


def test_a_third_of_all_rows_is_one_text(spark, tokenizer):
    docs = [(k, "a b c d e f g" if k % 3 else "word " * (k % 50)) for k in range(600)]
    check(M.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), length=64), docs, tokenizer, 64)


def test_empty_table(none):
    assert M.pack(none).collect() == [] and M.sequences(M.pack(none, with_ids=True)).collect() == []


def test_sequences_hold_the_texts(odd, tokenizer):
    pieces = M.pack(odd, length=100, with_ids=True).collect()
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in M.sequences(M.pack(odd, length=100, with_ids=True)).collect()}
    assert sum(map(len, got.values())) == sum(r["length"] for r in pieces)
    for r in pieces:
        assert got[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tobytes() == bytes(r["ids"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["It's I'LL", " ", "  \n", "\t", "é ́x", "<|endoftext|>", "<|end", "中文", " ", "12 345", "\x1c", "　", "\x85", "a", "😀"]), max_size=9).map("".join))
def test_encoder_gives_the_tokenizer_s_ids(tokenizer, text):
    assert M.encoder(M.default_vocabulary()).encode_to_numpy(text, allowed_special="all").tolist() + [2] == ids(tokenizer, text)
