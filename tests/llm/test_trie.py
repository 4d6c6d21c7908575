import collections
import hashlib
import random
import zlib

import pytest

from flockframe.llm import trie as T
from .tables import rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, band double"


def plain(turns):
    """The trie by whole prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(spark, turns):
    df = spark.createDataFrame([(*t, 3, "x", 0.5) for t in turns], SCHEMA).repartition(5)
    found = T.prefix_trie(df)
    assert found.columns == COLUMNS
    return rows(found.fillna(-1, "parent_conv_id"))


def test_odd_rows(spark):
    turns = [(0, 1, "user", "a"), (0, 0, None, "first"), (0, None, "user", None), (1, 0, "user", "a"), (1, 0, "user", "b"),
             (1, 0, "user", "a"), (2, 5, "", ""), (3, 0, "user", "ü" * 3000), (None, 0, "user", "nobody"), (4, None, None, None),
             (12, 0, "u", "base is absent"), (13, 0, "us", "er"), (13, 1, "u", "ser"), (10 ** 15, 0, "u", "far")]
    turns += [(5 + k, t, "user", f"t{t}") for k in range(5) for t in range(12)]
    assert got(spark, turns) == plain(turns)


def test_random_turns(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "yes", "no", "ä"]))
             for c in range(120) for t in range(rng.choice([0, 1, 2, 3, 8, 20]))]
    assert got(spark, turns) == plain(turns)


@pytest.mark.parametrize("band", [2, 16])
def test_deep_and_hot(spark, monkeypatch, band):
    """One conversation of a third of all rows, one beginning of most, bands within bands."""
    monkeypatch.setattr(T, "BAND", band)
    monkeypatch.setattr(T, "LINK", 3)
    turns = [(7, t, "user", f"x{t % 5}") for t in range(300)]
    turns += [(c, t, "user", f"x{t % 5}" if t < 20 or c % 7 else f"y{c}") for c in range(50, 110) for t in range(c % 41)]
    turns += [(c, 0, "user", "hello") for c in range(200, 260)]
    assert got(spark, turns) == plain(turns)


def test_empty_table(spark):
    assert got(spark, []) == [] == plain([])


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert rows(T.prefix_trie(table).fillna(-1, "parent_conv_id")) == plain(turns)
