"""Near-duplicates by one-permutation hashing with optimal densification.

One hash a shingle: the hash's place in its range picks a bin, the least hash of a bin is its
entry, and an empty bin borrows from the bin that a fixed probe sequence of its own finds first.
Bands of bins are the buckets; each bucket proposes only the pairs of its members with one centre,
and the links are confirmed on the whole shingle sets. Joins are merge joins at every size: each side grows with
the documents, and the driver would hold the broadcasts of all rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X
from .components import components

#: Words in a shingle; bands and bins in a band. A pair at 0.85 is missed with a chance of 1e-8.
WORDS, BANDS, ROWS = 5, 32, 5
BINS = BANDS * ROWS
PROBES = 1024

_STEP = (1 << 64) // BINS
_BOUNDS = (np.arange(1, BINS, dtype=np.uint64) * np.uint64(_STEP))
_BAND = X.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _donors() -> np.ndarray:
    """For each bin and attempt, the bin it asks."""
    bins, tries = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(PROBES, dtype=np.uint64)[None]
    return (X.mix(bins * np.uint64(PROBES) + tries + np.uint64(77)) % np.uint64(BINS)).astype(np.int16)


_DONORS = _donors()


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified entries of all bins for a non-empty, sorted set of hashes."""
    at = np.concatenate(([0], np.searchsorted(hashes, _BOUNDS), [len(hashes)]))
    full = at[:-1] < at[1:]
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for t in range(PROBES):
        if not len(empty):
            break
        asked = _DONORS[empty, t]
        found = full[asked]
        source[empty[found]] = asked[found]
        empty = empty[~found]
    source[empty] = np.flatnonzero(full)[0]
    return hashes[at[source]]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    entries = signature(hashes).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for i in range(ROWS):
        key = X.mix(key + entries[:, i])
    return key


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = X.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return int(hashes.sum(dtype=np.uint64).astype(np.int64)), int(a.sum(dtype=np.uint64).astype(np.int64))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                     ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("hashes", pa.binary())])


def _sign(batches):
    for rows, data, offsets in X.chunks(batches):
        n, prints, bands, ends = [], [], [], [0]
        for hashes in X.shingle_sets(*X.words(data, offsets), WORDS):
            n.append(len(hashes))
            prints.append(_fingerprint(hashes))
            if len(hashes):
                bands.append(band_keys(hashes).view(np.int64))
            ends.append(BANDS * len(bands))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield X.out(_SIGNED, doc_id=rows.column("doc_id").cast(pa.int64()), uid=rows.column("uid"), n_shingles=n,
                    f1=[p[0] for p in prints], f2=[p[1] for p in prints],
                    bands=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))


def _sets(batches):
    """Each different set of the task once."""
    seen = set()
    for _, data, offsets in X.chunks(batches):
        prints, sets = [], []
        for hashes in X.shingle_sets(*X.words(data, offsets), WORDS):
            p = _fingerprint(hashes)
            if len(hashes) and p not in seen:
                seen.add(p)
                prints.append(p)
                sets.append(hashes)
        if sets:
            yield X.out(_SETS, f1=[p[0] for p in prints], f2=[p[1] for p in prints], hashes=X.binary(sets))


_MEASURED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("n_both", pa.int64()),
                       ("n_any", pa.int64()), ("own", pa.list_(pa.int64()))])


def _measure(batches):
    """Overlap of the sets of a and b, and what b's set has for itself (own)."""
    for batch in batches:
        n, both, any_, own = [], [], [], []
        for x, y in zip(batch.column("left"), batch.column("right")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            common = int(shared.sum())
            n.append(len(y))
            both.append(common)
            any_.append(len(x) + len(y) - common)
            own.append(y[~shared].view(np.int64))
        yield X.out(_MEASURED, a=batch.column("a"), b=batch.column("b"), n=n, n_both=both, n_any=any_,
                    own=pa.array(own, pa.list_(pa.int64())))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of intersection and union of the sets of pairs (a, b); size and own elements of b's."""
    left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(
        _measure, "a long, b long, n long, n_both long, n_any long, own array<long>")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Rows link where 100 * |A & B| >= percent * |A | B| of their sets of five-word shingles
    (``percent`` of 80 or more; the bands are made for that). ``component_id`` is the least id reachable;
    ``kept`` marks the rows with that id. Equal sets are one class and never expanded into pairs.

    In each bucket the class that meets most others over all its buckets is the centre of a star: among copies
    of one text that is the text itself. The star's links are confirmed on whole sets and joined into components.
    Members of one star that are then still in different components are compared too, where exact bounds
    allow them a link (see ``_remaining``). So no link inside a bucket is lost, while near copies cost one pair each.

    Null, empty and blank texts have an empty set and link with nothing. Fewer than five words count as one
    shingle. Rows without an id take part in links; where all of a group lack one, component_id is null and
    kept is false. Repeated rows (same id) get the same answer. Other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.withColumnRenamed(id_column, "doc_id") if id_column != "doc_id" else docs
    rows = X.documents(docs, F.col("doc_id")).withColumn("uid", F.monotonically_increasing_id())
    signed = checkpoint(rows.select("doc_id", "uid", "text").mapInArrow(
        _sign, "doc_id long, uid long, n_shingles long, f1 long, f2 long, bands array<long>"))
    texts = rows.select("text")

    classes = signed.filter("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min("uid").alias("cid"), F.min("n_shingles").alias("n"))
    entries = (signed.filter("n_shingles > 0").select("f1", "f2", F.explode("bands").alias("key")).distinct())
    crowded = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = checkpoint(entries.join(crowded.hint("merge"), "key").join(classes.hint("merge"), ["f1", "f2"]).select("key", "size", "cid"))
    popular = members.groupBy("cid").agg(F.sum("size").alias("met"))
    centres = (members.join(popular.hint("merge"), "cid").groupBy("key").agg(F.min(F.struct(-F.col("met"), "cid")).alias("c"))
               .select("key", F.col("c.cid").alias("a")))
    stars = checkpoint(members.join(centres.hint("merge"), "key").filter("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    involved = popular.select("cid").join(classes.hint("merge"), "cid")
    sets = checkpoint(texts.mapInArrow(_sets, "f1 long, f2 long, hashes binary").join(involved.hint("merge"), ["f1", "f2"])
                      .groupBy("cid").agg(F.first("hashes").alias("hashes")))
    measured = checkpoint(_overlaps(stars, sets))
    linked = f"100 * n_both >= {percent} * n_any"
    links = measured.filter(linked).select("a", "b")
    rest = checkpoint(_remaining(measured, components(links), percent))
    links = checkpoint(links.union(_overlaps(rest, sets).filter(linked).select("a", "b")))
    roots = components(links)
    classes = (classes.join(roots.hint("merge"), classes["cid"] == roots["node"], "left")
               .select("f1", "f2", F.coalesce("root", "cid").alias("root")))
    whole = checkpoint(signed.select("doc_id", "n_shingles", "f1", "f2", "uid").join(classes.hint("merge"), ["f1", "f2"], "left")
                       .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"), "uid"))
    # written, so that the join has a plain table on either side and a large group's partition is split
    least = checkpoint(whole.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")))
    alone = whole.filter("root is null").withColumn("least", F.col("doc_id"))
    result = whole.filter("root is not null").join(least.hint("merge"), "root").unionByName(alone)
    return result.select("doc_id", "n_shingles", F.col("least").alias("component_id"),
                         F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)).alias("kept"))


def _remaining(measured: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one star, in different components, that may link.

    Order the elements of a star with those outside the centre's set first, rare ones before common ones. Two sets
    that overlap in ``percent`` of either share one of the first p = n - ceil(n * percent / 100) + 1 elements of each.
    Either that is an element outside the centre's set: such pairs are joined on it. Elements of a single member
    take their places in its prefix and need no look-up, and passages that many share come last.
    Or both prefixes reach into the centre's set, and nothing outside it is shared. Then the sets differ from the
    centre's by m missing and o own elements, of which at most the lesser number missing can agree, and
    (centre - greater m) / (centre + both o - lesser m) bounds their similarity: such pairs are joined by their (m, o).
    """
    rooted = measured.join(roots.hint("merge"), F.col("b") == F.col("node"), "left").select(
        "a", "b", "n", (F.col("n_any") - F.col("n") + F.col("n_both")).alias("centre"), "own",
        (F.col("n_any") - F.col("n")).alias("m"), (F.col("n") - F.col("n_both")).alias("o"),
        (1 - F.col("n_both") / F.col("n_any")).alias("d"),
        F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1").alias("p"), F.coalesce("root", "b").alias("root"))
    split = rooted.groupBy("a").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("a")
    rooted = checkpoint(rooted.join(split.hint("merge"), "a"))

    own = rooted.select("a", "b", F.explode("own").alias("e"))
    common = own.groupBy("a", "e").agg(F.count("*").alias("having")).filter("having > 1")
    common = (own.join(common.hint("merge"), ["a", "e"]).groupBy("a", "b")
              .agg(F.sort_array(F.collect_list(F.struct("having", "e"))).alias("common")))
    places = F.greatest(F.col("p") - F.col("o") + F.size("common"), F.lit(0)).cast("int")
    entries = rooted.join(common.hint("merge"), ["a", "b"]).select(
        "a", "b", "n", "d", "root", F.explode(F.slice("common", F.lit(1), places)["e"]).alias("e"))
    mixed = entries.groupBy("a", "e").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("a", "e")
    entries = checkpoint(entries.join(mixed.hint("merge"), ["a", "e"]))
    other = entries.select("a", "e", *[F.col(c).alias(f"{c}2") for c in ("b", "n", "d", "root")])
    outside = (entries.join(other.hint("merge"), ["a", "e"]).filter("b < b2 and root <> root2")
               .filter(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
               .filter(f"abs(d - d2) <= {1 - percent / 100 + 1e-9}").select("b", "b2"))

    reaching = rooted.filter("o < p").select("a", "b", "centre", "m", "o", "root")
    kinds = reaching.select("a", "centre", "m", "o").distinct()
    other = kinds.select("a", F.col("m").alias("m2"), F.col("o").alias("o2"))
    bound = f"100 * (centre - greatest(m, m2)) >= {percent} * (centre + o + o2 - least(m, m2))"
    kinds = kinds.join(other.hint("merge"), "a").filter(bound).select("a", "m", "o", "m2", "o2")
    right = reaching.select("a", F.col("m").alias("m2"), F.col("o").alias("o2"), F.col("b").alias("b2"),
                            F.col("root").alias("root2"))
    inside = (reaching.join(kinds.hint("merge"), ["a", "m", "o"]).join(right.hint("merge"), ["a", "m2", "o2"])
              .filter("b < b2 and root <> root2").select("b", "b2"))
    return (outside.union(inside).select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct()
            .join(measured.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
