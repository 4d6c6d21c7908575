"""Near-duplicate vectors by NN-descent.

Each vector keeps a list of its nearest found so far. The lists start from blocks of vectors that agree in
signs of random projections; in each round the neighbours of a vector, both ways, are compared with each other. Rounds
go on until the links in the lists stand still. Then a query set is compared with all vectors; where the lists miss links
of it, they are made twice as long, blocks of new projections are added, and the rounds go on. Where a list is full of links
its vector is saturated, and links may be missing from it: the components of such vectors are compared whole, in blocks,
within themselves and with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from .components import components

NEIGHBOURS = 8
#: Sign tables at least; more where a pair at the threshold would meet in none with a chance above MISSED.
TABLES, BLOCK, MISSED = 4, 64, 0.005
#: Share of the query set's links to be found; links below which more is asked, up to so many hundredths of the vectors.
RECALL, EVIDENCE, ASKED = 0.98, 100, 3
#: Times that lists are made longer. What has not got there then is compared whole.
WIDER = 5
#: Vectors of the query set (all with an id divisible by 100) that are compared with all at a time.
QUERIES = 2048
#: Vectors of a saturated component that one block holds, and balls about blocks that are compared at a time.
LARGE_BLOCK = 512
BALLS = 4096
#: Vectors of a block where all are compared.
EXACT_BLOCK = 2048


def _groups(batches, *keys: str):
    """Row groups with equal keys of batches sorted by them, as tables."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        cut = [0, *_changes(rest, keys)]
        for a, b in zip(cut, cut[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cut[-1])
    if rest is not None and len(rest):
        yield rest


def _changes(table: pa.Table, keys) -> list[int]:
    new = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        new |= v[1:] != v[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def _vectors(column) -> np.ndarray:
    """Unit vectors, as rows, of binary double components."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


_CLASS = "cid long, vec_id long, dim int, vector binary"


def _unit(batches):
    """Direction of each usable vector in double precision."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])
    for batch in batches:
        ids, dims, units = [], [], []
        for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            v = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64) if value.is_valid else np.zeros(0)
            usable = len(v) > 0 and not value.values.null_count and np.isfinite(v).all() and v.any()
            if usable:
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
            ids.append(vec_id)
            dims.append(len(v) if usable else 0)
            units.append(v.tobytes() if usable else b"")
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], schema=schema)


def _tables(bits: int, threshold: float) -> int:
    """Sign tables in which a pair at ``threshold`` agrees in all bits at least once, but for a chance of MISSED."""
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-together)))) if together < 1 else TABLES


def _signs(tables: int, seed: int = 0):
    """For each table, the signs of a vector's random projections."""
    schema = pa.schema([("t", pa.int32()), ("dim", pa.int32()), ("code", pa.int64()), ("cid", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                rows = batch.take(pa.array(own))
                x = _vectors(rows.column("vector"))
                planes = np.random.default_rng([8, int(dim), seed])
                for t in range(tables):
                    signs = x @ planes.standard_normal((int(dim), 30)) > 0
                    code = signs @ (1 << np.arange(29, -1, -1, dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(own), t, np.int32)), rows.column("dim"), pa.array(code),
                                           rows.column("cid"), rows.column("vector")], schema=schema)
    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


def _best(ids: np.ndarray, cosines: np.ndarray, k: int, keep: np.ndarray | None = None):
    """The k nearest of each vector of a block among the others."""
    np.fill_diagonal(cosines, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    a, b, c = np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(cosines, at, 1).ravel()
    return a, b, c


def _compare(keys: tuple[str, ...], k: int):
    """Nearest vectors within each group of rows."""
    def run(batches):
        found, size = [], 0
        for group in _groups(batches, *keys):
            if len(group) < 2:
                continue
            ids = group.column("cid").to_numpy()
            x = _vectors(group.column("vector"))
            for part in range(0, len(ids), 4 * BLOCK):  # a crowded group goes in blocks
                own = slice(max(0, min(part, len(ids) - 4 * BLOCK)), part + 4 * BLOCK)
                found.append(_best(ids[own], _cosines(x[own], x[own]), k))
                size += len(found[-1][0])
            if size > 100_000:
                yield _rows(found)
                found, size = [], 0
        if found:
            yield _rows(found)
    return run


def _rows(found):
    return pa.record_batch([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], schema=_FOUND)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Lists (a, b, cosine) of the k nearest different b of each a.

    A pair that met in several blocks may differ in its cosine's last bits; it has one place.
    """
    found = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    best = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("cosine", "b")), False), 1, k).alias("l"))
    return best.select("a", F.explode("l").alias("n")).select("a", "n.b", "n.cosine")


def _start(vectors: DataFrame, n: int, k: int, threshold: float, seed: int = 0) -> DataFrame:
    """Lists from blocks of vectors with the same signs, of about BLOCK where signs are even; crowded blocks are dealt out."""
    bits = max(0, int(np.log2(max(1, n / BLOCK))))
    coded = vectors.select("cid", "dim", "vector").mapInArrow(
        _signs(_tables(bits, threshold), seed), "t int, dim int, code long, cid long, vector binary")
    coded = coded.withColumn("code", F.shiftright("code", 30 - min(30, bits)))
    crowd = checkpoint(coded.select("t", "dim", "code").groupBy("t", "dim", "code").count())
    coded = coded.join(crowd, ["t", "dim", "code"])
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("count") / (3 * BLOCK))).cast("long")
    coded = coded.withColumn("part", part).select("t", "dim", "code", "part", "cid", "vector")
    keys = ("t", "dim", "code", "part")
    found = coded.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(_compare(keys, k), "a long, b long, cosine double")
    return checkpoint(_nearest(found, k))


def _round(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: around each vector, those in its list and those that list it meet.

    A vector that very many list meets them in parts of its own.
    """
    around = lists.select(F.col("a").alias("v"), F.col("b").alias("cid")).union(lists.select(F.col("b").alias("v"), F.col("a").alias("cid")))
    around = around.union(lists.select(F.col("a").alias("v"), F.col("a").alias("cid"))).distinct()
    crowd = checkpoint(around.groupBy("v").count())
    around = around.join(crowd, "v").withColumn(
        "part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("count") / (3 * BLOCK))).cast("long")).select("v", "part", "cid")
    met = around.join(vectors.select("cid", "dim", "vector"), "cid")
    keys = ("v", "dim", "part")
    found = met.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(_compare(keys, k), "a long, b long, cosine double")
    return checkpoint(_nearest(lists.union(found), k))


def _audit(lists: DataFrame, vectors: DataFrame, threshold: float, k: int = NEIGHBOURS) -> tuple[int, int]:
    """Links of the query set, found by comparing it with all vectors, and how many of them the lists of ``k`` have.

    The query set is all vectors ``asked``, and goes to the workers in packs. A link of two vectors whose lists are both full of links counts as found: their components are compared whole later. Such are only counted.
    """
    links = lists.filter(F.col("cosine") >= threshold).select("a", "b")
    full = links.groupBy("a").count().filter(F.col("count") >= k).select(F.col("a").alias("cid"), F.lit(True).alias("full"))
    vectors = checkpoint(vectors.join(full, "cid", "left").select("cid", "dim", "vector", "asked", F.coalesce("full", F.lit(False)).alias("full")))
    known = checkpoint(links.union(links.select("b", "a")).distinct().withColumn("known", F.lit(1)))
    asked = vectors.filter("asked")
    packs = max(1, -(-asked.count() // QUERIES))
    n = found = 0
    for p in range(packs):
        pack = asked.filter(F.pmod(F.xxhash64("cid"), F.lit(packs)) == p).select("cid", "dim", "vector", "full").toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(pack)
        true = vectors.select("cid", "dim", "vector", "full").mapInArrow(_true(sent, threshold), "a long, b long, k long")
        row = true.join(known, ["a", "b"], "left").agg(
            F.sum("k"), F.sum(F.when(F.col("known").isNotNull() | F.col("a").isNull(), F.col("k")))).first()
        n, found = n + (row[0] or 0), found + (row[1] or 0)
        sent.unpersist()
    return n, found


def _true(sent, threshold: float):
    """Links (a, b) of a pack of vectors to all; of links whose ends both have full lists only the number, without ends."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64())])

    def run(batches):
        pack = sent.value
        dims = pack.column("dim").to_numpy()
        by_dim = {}
        for dim in np.unique(dims):
            rows = pack.take(pa.array(np.flatnonzero(dims == dim)))
            by_dim[int(dim)] = rows.column("cid").to_numpy(), _vectors(rows.column("vector")), np.array(rows.column("full").to_pylist(), bool)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in by_dim:
                    continue
                ids, queries, full = by_dim[int(dim)]
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), QUERIES):
                    rows = batch.take(pa.array(own[at:at + QUERIES]))
                    i, j = np.nonzero(_cosines(queries, _vectors(rows.column("vector"))) >= threshold)
                    a, b = ids[i], rows.column("cid").to_numpy()[j]
                    both = full[i] & np.array(rows.column("full").to_pylist(), bool)[j]
                    counted, listed = int((both & (a != b)).sum()), ~both & (a != b)
                    yield pa.record_batch([pa.array([*a[listed].tolist(), None], pa.int64()), pa.array([*b[listed].tolist(), None], pa.int64()),
                                           pa.array([1] * int(listed.sum()) + [counted], pa.int64())], schema=schema)
    return run


def _audited(lists: DataFrame, classes: DataFrame, threshold: float, k: int) -> tuple[int, int]:
    """``_audit`` of the vectors with an id divisible by 100; where these have few links, of further hundredths."""
    links = found = 0
    for turn in range(ASKED):
        more = _audit(lists, classes.withColumn("asked", F.col("turn") == turn), threshold, k)
        links, found = links + more[0], found + more[1]
        if links >= EVIDENCE:
            break
    return links, found


def _settled(classes: DataFrame, n: int, k: int, threshold: float) -> tuple[DataFrame | None, int, float]:
    """Lists after as many rounds as it takes, their length and their audited recall (1 where no link was met); no lists
    where longer ones and new projections do not reach the recall either."""
    lists = _start(classes, n, k, threshold)
    for wider in range(1, WIDER + 2):
        before = None
        while True:
            lists = _round(lists, classes, k)
            link = F.col("cosine") >= threshold
            now = tuple(lists.agg(F.count_if(link), F.sum(F.when(link, F.xxhash64("a", "b") % (1 << 31)))).first())
            if now == before:
                break
            before = now
        links, found = _audited(lists, classes, threshold, k)
        if found >= RECALL * links:
            return lists, k, found / links if links else 1.0
        if wider <= WIDER:
            k *= 2
            lists = checkpoint(_nearest(lists.union(_start(classes, n, k, threshold, wider)), k))
    return None, k, 1.0


def _balls(batches):
    """For each block of vectors its least cid, and the ball about it: mean direction and greatest angle."""
    schema = pa.schema([("root", pa.int64()), ("dim", pa.int32()), ("part", pa.int64()), ("block", pa.int64()),
                        ("centre", pa.binary()), ("radius", pa.float64())])
    for group in _groups(batches, "root", "dim", "part"):
        v = _vectors(group.column("vector"))
        centre = v.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if centre.any() else v[0]
        radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
        head = group.slice(0, 1)
        yield pa.record_batch([*[head.column(c).combine_chunks() for c in ("root", "dim", "part", "cid")],
                               pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], schema=schema)


def _may_link(threshold: float):
    """Pairs of blocks (x <= y) whose balls are near enough for a link between them."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
    reach = float(np.arccos(threshold)) + 1e-6

    def run(batches):
        for group in _groups(batches, "dim", "i", "j"):
            own, i, j = (group.column(c).to_numpy() for c in ("own", "i", "j"))
            ids, radius, v = group.column("block").to_numpy(), group.column("radius").to_numpy(), _vectors(group.column("centre"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for k in range(0, len(left), 512):
                part = left[k:k + 512]
                angles = np.arccos(np.clip(_cosines(v[part], v[right]), -1, 1))
                p, q = np.nonzero(angles <= radius[part][:, None] + radius[right] + reach)
                x, y = ids[part[p]], ids[right[q]]
                once = (x <= y) | (i[0] != j[0])  # within one group each pair comes both ways
                yield pa.record_batch([pa.array(np.minimum(x, y)[once]), pa.array(np.maximum(x, y)[once])], schema=schema)
    return run


def _least_reached(linked: np.ndarray, square: bool) -> np.ndarray:
    """For each row, and after them each column, the first one reachable over links; a square's rows are its columns."""
    p, q = linked.shape
    label = np.arange(p if square else p + q)
    while True:
        before = label.copy()
        rows, columns = label[:p], label if square else label[p:]
        rows = np.minimum(rows, np.where(linked, columns, len(label)).min(axis=1))
        if square:
            label = rows
        else:
            label = np.concatenate([rows, np.minimum(columns, np.where(linked, rows[:, None], len(label)).min(axis=0))])
        label = label[label]
        if (label == before).all():
            return label


def _counted(threshold: float):
    """Links of each vector of a pair of blocks to the other block, weighted by copies, and a vector they lead to."""
    schema = pa.schema([("cid", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for group in _groups(batches, "x", "y"):
            block = group.column("block").to_numpy()
            x, y = int(group.column("x")[0].as_py()), int(group.column("y")[0].as_py())
            ids, copies, v = group.column("cid").to_numpy(), group.column("copies").to_numpy(), _vectors(group.column("vector"))
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            linked = _cosines(v[left], v[right]) >= threshold
            if x == y:
                np.fill_diagonal(linked, False)
                every, links = ids[left], linked @ copies[right]
            else:
                every, links = ids[np.concatenate([left, right])], np.concatenate([linked @ copies[right], copies[left] @ linked])
            if not links.any():
                continue
            to = every[_least_reached(linked, x == y)]
            some = links > 0
            yield pa.record_batch([pa.array(every[some]), pa.array(to[some]), pa.array(links[some])], schema=schema)
    return run


def _enlarged(classes: DataFrame, rooted: DataFrame, threshold: float, size: int) -> DataFrame:
    """(cid, to, links): all links among the vectors of ``rooted`` (cid, root), within components and between them.

    Members of a component go in blocks. Two blocks are compared, each pair in a task, unless the balls
    about them are too far apart for a link: what is left out holds none. A block's rows of ``to`` join its linked vectors.
    """
    members = rooted.join(classes, "cid").select("cid", "root", "dim", "copies", "vector")
    parts = checkpoint(members.groupBy("root", "dim").agg(F.ceil(F.count("*") / size).alias("parts")))
    members = checkpoint(members.join(parts, ["root", "dim"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).drop("parts"))
    keys = ("root", "dim", "part")
    balls = checkpoint(members.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(
        _balls, "root long, dim int, part long, block long, centre binary, radius double"))
    groups = max(1, -(-balls.count() // BALLS))
    # a group of balls meets itself and each other one once: it goes to every pair (i <= j) that has it
    own = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")),
                        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    met = balls.withColumn("own", own).withColumn("p", F.explode(pairs)).select(
        "dim", "p.i", "p.j", "own", "block", "radius", "centre")
    keys = ("dim", "i", "j")
    pairs = checkpoint(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_may_link(threshold), "x long, y long"))
    sides = pairs.select(F.col("x").alias("block"), "x", "y").union(pairs.filter("x < y").select(F.col("y").alias("block"), "x", "y"))
    members = checkpoint(members.join(balls.select("root", "dim", "part", "block"), ["root", "dim", "part"]).select(
        "block", "cid", "copies", "vector"))
    met = members.join(sides, "block").select("x", "y", "block", "cid", "copies", "vector")
    return checkpoint(met.repartition("x", "y").sortWithinPartitions("x", "y", "cid").mapInArrow(
        _counted(threshold), "cid long, to long, links long"))


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row for each row of ``embeddings``: vec_id, n_links, component_id, kept, recall.

    Vectors link at a cosine (double precision) of ``threshold`` or more. Equal vectors are one class that counts as many
    as it has; no pairs of copies are made. ``n_links`` counts other rows, ``component_id`` is the least vec_id reachable,
    ``kept`` marks it. Rounds go on until the links found stand still; lists grow until the audited ``recall`` (one value) is 0.98.
    The links found are exact; a pair at the threshold that no audit shows meets in a first block but for a chance of 0.005.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length never link. Rows without an id take part, with a null id; a group of such only has a null component
    and is not kept. Repeated rows are copies of each other. Other columns are not looked at; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpoint(rows.mapInArrow(_unit, "vec_id long, dim int, vector binary")
                      .withColumn("uid", F.monotonically_increasing_id()))
    usable = rows.filter("dim > 0")
    classes = checkpoint(usable.groupBy("dim", "vector").agg(
        F.min("uid").alias("cid"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"),
        F.coalesce(F.max(F.col("vec_id") % 100 == 0), F.lit(False)).alias("hundred")))
    classes = classes.withColumn("turn", F.when(F.col("hundred"), 0).otherwise(1 + F.pmod(F.xxhash64("cid"), F.lit(99)))).drop("hundred")
    n = classes.count()
    lists, neighbours, recall = _settled(classes, n, neighbours, threshold)
    if lists is None:  # all vectors are as one component to compare
        links = classes.selectExpr("cid a", "cid b").limit(0)
        roots = classes.selectExpr("cid", "cid root").limit(0)
        inside, size = classes.select("cid", F.lit(0).cast("long").alias("root")), EXACT_BLOCK
    else:
        links = lists.filter(F.col("cosine") >= threshold).select("a", "b")
        links = checkpoint(links.union(links.select("b", "a")).distinct())
        roots = checkpoint(components(links).withColumnRenamed("node", "cid"))
        full = links.groupBy("a").count().filter(F.col("count") >= neighbours).select(F.col("a").alias("cid"))
        saturated = roots.join(full, "cid").select("root").distinct()
        inside, size = checkpoint(roots.join(checkpoint(saturated), "root")), LARGE_BLOCK
    compared = _enlarged(classes, inside.select("cid", "root"), threshold, size)
    enlarged = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = checkpoint(components(roots.select(F.col("cid").alias("a"), F.col("root").alias("b")).union(
        compared.filter("cid <> to").select("cid", "to").distinct())).withColumnRenamed("node", "cid"))
    plain = (links.join(inside.select(F.col("cid").alias("a")), "a", "left_anti")
             .join(classes.select(F.col("cid").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("links")))
    counted = enlarged.union(plain)
    each = (classes.join(counted, "cid", "left").join(roots, "cid", "left").select(
        "dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "cid").alias("root"), F.col("vec_id").alias("least")))
    least = checkpoint(each.groupBy("root").agg(F.min("least").alias("component_id")))
    each = checkpoint(each.drop("least").join(least, "root").drop("root"))
    found = usable.join(each, ["dim", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn(
        "recall", F.lit(float(recall)))
