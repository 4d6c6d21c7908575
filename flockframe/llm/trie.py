"""Prefix trie of conversations, its totals by depth-band rollup.

A conversation's first d turns are told apart by 128 bits, the exclusive or of a digest of each turn with its place, so a
node is the key of its prefix and needs no parent to be found. The depths are cut into bands of fixed height. Inside a
band each node's numbers go to its ancestors there; the totals of the bands' top nodes, which make a trie of a
fraction of the depth, come from the same rollup of that trie and flow to the band above. So no number travels
further than a band, and the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint
from . import text as X

#: Depths in a band; conversations share the first turns of the first of their group, at most MOST_SHARED - 1.
BAND = 16
GROUP, MOST_SHARED = 5, 9
#: Ids in one link of the chain that a node's list of ids is hashed by.
LINK = 256
KEY = ("k1", "k2")

_TURNS = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("local", pa.int64()), ("digest", pa.binary()),
                    ("n_bytes", pa.int64())])


def _count_up(batches):
    """Number the rows of each conversation inside a sorted partition."""
    last, seen = None, 0
    for rows in batches:
        if not len(rows):
            continue
        conv = rows.column("conv_id").to_numpy()
        new = np.flatnonzero(np.concatenate(([last is None or conv[0] != last], conv[1:] != conv[:-1])))
        started = np.full(len(conv), -seen if last is not None else 0)
        marks = np.zeros(len(conv), np.int64)
        marks[new] = 1
        at = np.cumsum(marks) - 1
        started[at >= 0] = new[at[at >= 0]]
        local = np.arange(len(conv)) - started
        last, seen = conv[-1], int(local[-1]) + 1
        yield X.out(_TURNS, **{c: local if c == "local" else rows.column(c) for c in _TURNS.names})


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and n_bytes of each turn, by turn (null first), equal turns by digest.

    A range sort deals out the turns, so a conversation of any length is spread; a partition's turns are
    numbered on their own, and the few numbers of where conversations go on from one to the next are added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = checkpoint(turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    local = checkpoint(ranged.select(F.spark_partition_id().alias("part"), "conv_id", F.lit(0).cast("long").alias("local"),
                                     "digest", "n_bytes")
                       .mapInArrow(_count_up, "part int, conv_id long, local long, digest binary, n_bytes long"))
    # a conversation in several partitions: each has one row of these, and only its first and last conversation are such
    here = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    spread = here.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = here.join(spread, "conv_id").select("conv_id", "part", F.sum("n").over(ahead).alias("before"))
    return local.join(before, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("before", F.lit(0)) + 1).alias("place"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, length), and their turns (conv_id, depth, digest, n_bytes).

    The first h turns of conversation c - c % 5 come first (all if it has fewer), then c's own after its first h.
    """
    turns = checkpoint(numbered(turns))
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = checkpoint(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("shared"), "n"))
    own = turns.join(convs.filter("n > h").select("conv_id", "h", "shared"), "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "digest", "n_bytes")
    first = turns.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    first = first.join(convs.filter("shared > 0").select("conv_id", "base", "h"), "base").filter("place <= h").select(
        "conv_id", F.col("place").alias("depth"), "digest", "n_bytes")
    lengths = convs.select("conv_id", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, first.union(own)


def _paths(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, ends) of each conversation at each depth, the root's 0 as well.

    k is the key of the node, p the key of its parent.
    """
    lanes = {"t1": F.xxhash64("depth", "digest"), "t2": F.xxhash64("digest", F.lit(7), "depth")}
    band = F.floor((F.col("depth") - 1) / BAND)
    turns = checkpoint(turns.withColumns(lanes).drop("digest").withColumn("band", band))
    deep = turns.groupBy("conv_id", "band").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    long = lengths.filter(F.col("length") > BAND).select("conv_id")
    ahead = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpoint(deep.join(long, "conv_id").select("conv_id", "band", *[
        F.bit_xor(f"b{i}").over(ahead).alias(f"c{i}") for i in (1, 2)]).filter("band > 0"))
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    path = turns.select("conv_id", "band", "depth", "n_bytes", "t1", "t2",
                        *[F.bit_xor(f"t{i}").over(inside).alias(f"x{i}") for i in (1, 2)])
    path = path.join(carried, ["conv_id", "band"], "left").withColumns({
        f"k{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)})
    path = path.select("conv_id", "depth", *KEY, *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)],
                       "n_bytes")
    none = F.lit(0).cast("long")
    roots = lengths.select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), none.alias("p1"),
                           none.alias("p2"), none.alias("n_bytes"))
    return path.union(roots).join(lengths, "conv_id").withColumn("ends", F.col("depth") == F.col("length")).drop("length")


def _rollup(path: DataFrame, own: DataFrame, deepest: int) -> DataFrame:
    """(k1, k2, leaves, saved): totals over the subtree of every node.

    ``path``: (conv_id, depth, k1, k2) of each conversation. ``own``: (conv_id, depth, leaves, saved), a node's numbers at
    the conversation that stands for it.
    """
    band = F.floor(F.col("depth") / BAND)
    if deepest >= BAND:
        # the bands' top nodes are a trie of their own: what hangs on each inside its band is its own number there
        tops = checkpoint(path.filter(F.col("depth") >= BAND).filter(F.col("depth") % BAND == 0)
                          .select("conv_id", (F.col("depth") / BAND).cast("long").alias("depth"), *KEY))
        deep = own.filter(F.col("depth") >= BAND)
        inside = (deep.groupBy("conv_id", band.alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
                  .join(tops, ["conv_id", "depth"]).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        standing = checkpoint(deep.filter(F.col("depth") % BAND == 0)
                              .select("conv_id", (F.col("depth") / BAND).cast("long").alias("depth"))
                              .join(tops, ["conv_id", "depth"]))
        above = checkpoint(standing.join(inside, [*KEY]).select("conv_id", "depth", "leaves", "saved"))
        totals = _rollup(tops, above, deepest // BAND)
        # a top's total counts for all of its conversation's nodes in the band above: it hangs on the last of them
        hung = standing.join(totals, [*KEY]).select("conv_id", (F.col("depth") * BAND - 1).alias("depth"), "leaves", "saved")
        own = own.union(hung)
    numbers = own.groupBy("conv_id", band.alias("band")).agg(
        F.collect_list(F.struct("depth", "leaves", "saved")).alias("own"))
    keys = path.groupBy("conv_id", band.alias("band")).agg(F.collect_list(F.struct("depth", *KEY)).alias("nodes"))

    def below(what):
        return F.expr(f"aggregate(own, 0L, (s, x) -> s + if(x.depth >= node.depth, x.{what}, 0L))").alias(what)
    sums = (keys.join(numbers, ["conv_id", "band"]).select("own", F.explode("nodes").alias("node"))
            .select("node.k1", "node.k2", below("leaves"), below("saved")))
    return checkpoint(sums.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))


def _hash_chain(batches):
    """SHA-256 of each node's ids, whose links come in order; memory of one batch."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for rows in batches:
        done = []
        for k1, k2, ids in zip(*(rows.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.record_batch([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
    if node:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), schema)], schema=schema)


def _ends(path: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes at which conversations end: SHA-256 of their ids, ascending, by commas."""
    link = F.floor(F.col("conv_id") / LINK).alias("link")  # at most LINK different ids
    links = path.filter("ends").groupBy(*KEY, link).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return (links.repartition(*KEY).sortWithinPartitions(*KEY, "link").select(*KEY, "ids")
            .mapInArrow(_hash_chain, "k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, turn, role, text) are ordered by turn, null first, equal turns by the digest of role and text;
    repeated rows are turns of their own. Null role or text is empty. Rows without a conv_id belong to no conversation and
    are left out. A conversation is rebuilt from the first turns of its group's first and its own rest, see
    ``rebuilt``; nodes are the different beginnings of rebuilt conversations, the root being the empty one. ``conv_id``
    is the least member. An empty table gives no rows. Other columns are not looked at.

    Nodes that many conversations share are aggregated before they are shuffled; a conversation of many turns is
    cut by bands.
    """
    lengths, rest = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    path = checkpoint(_paths(checkpoint(lengths), rest))
    nodes = checkpoint(path.groupBy(*KEY, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("conv_id", "depth", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    totals = _rollup(path.select("conv_id", "depth", *KEY), own, deepest)
    null = F.lit(None)
    told = nodes.select(*KEY, "depth", "conv_id", "n_convs", null.cast("long").alias("n_children"), null.cast("long").alias("leaves"),
                        null.cast("long").alias("saved"), null.cast("string").alias("ends_sha256"))
    told = (told.unionByName(nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
                             .withColumnsRenamed({"p1": "k1", "p2": "k2"}), allowMissingColumns=True)
            .unionByName(totals, allowMissingColumns=True).unionByName(_ends(path), allowMissingColumns=True))
    # every column has one value a node, so one shuffle brings them together
    told = told.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in told.columns if c not in KEY])
    child = checkpoint(nodes.filter("depth > 0").select(*KEY, "p1", "p2"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parents = child.join(parents, ["p1", "p2"]).select(*KEY, "parent_conv_id")
    return told.join(parents, [*KEY], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
