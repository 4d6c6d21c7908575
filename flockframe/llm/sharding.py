"""Shards of near equal bytes by sampled splitters.

Keys are hashes of the text, so equal texts lie together. A sample of keys, weighted by size, gives quantile boundaries;
records are dealt into ranges between them, ranges that came out too full are divided again, and the
ranges in order fill the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X

SHARDS = 8
#: Ranges at least, rows of a range at most on average, and sampled keys a range.
RANGES, RANGE_ROWS, SAMPLED = 256, 1_000_000, 24
#: A group of equal texts below this share of a shard is never cut.
WHOLE_GROUP = 0.005


class Splitters:
    """Sorted boundaries (key, tie); a record's range is the number of boundaries not above it.

    The first boundary of a key lies ahead of all its records: only a key with several is cut.
    """

    def __init__(self, points: list[tuple[int, int]]):
        points = sorted(set(points))
        points = sorted({(k, t if i and points[i - 1][0] == k else -1 << 63) for i, (k, t) in enumerate(points)})
        self.points = points
        self.keys = np.array([p[0] for p in points], np.int64)
        self.ties = np.array([p[1] for p in points], np.int64)

    def place(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = high.copy()
        for a in np.unique(low[low < high]):  # keys that are boundaries themselves
            own = np.flatnonzero((low == a) & (low < high))
            out[own] = a + np.searchsorted(self.ties[a:high[own[0]]], tie[own], "right")
        return out


_KEYED = "uid long, doc_id long, size long, text_crc32 long, key long, tie long"
_RANGED = pa.schema([("range", pa.int64()), *[(c.split()[0], pa.int64()) for c in _KEYED.split(", ")]])


def _deal(splitters):
    def run(batches):
        for batch in batches:
            place = splitters.value.place(batch.column("key").to_numpy(), batch.column("tie").to_numpy())
            yield pa.record_batch([pa.array(place, pa.int64()), *batch.columns], schema=_RANGED)
    return run


def _sample(rows: DataFrame, weight, number: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``number`` (key, tie, weight) drawn with chances by weight, the same ones at each run.

    A record heavier than a step of the sample is drawn for certain, with what it weighs.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return []
    step = total / number
    draw = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / (1 << 30) * step
    return [tuple(r) for r in rows.filter(draw < weight).select("key", "tie", F.greatest(weight, F.lit(step))).collect()]


def _quantiles(sample, parts: int) -> list[tuple[int, int]]:
    sample = sorted(sample)
    ends = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(ends, np.arange(1, parts) * (ends[-1] / parts)) if sample else []
    return [sample[k][:2] for k in at]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    ``size`` is the UTF-8 bytes of the text plus 1. Shards come near equal in bytes: records in key order are
    cut where the running size passes a shard's share. A group of equal texts stays in one shard unless it has more
    than 0.5 % of a shard's bytes; a larger one may be cut between its records, which a hash of the row orders. ``slot``
    numbers a shard's records from 0 without gaps.

    Null texts are empty: size 1, crc32 0. Repeated documents, and those without an id (null), are records
    of their own. Other columns are not looked at; an empty table gives no rows; with fewer records than
    shards some shards stay empty.
    """
    spark = docs.sparkSession
    rows = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = checkpoint(rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key"))
        .withColumn("tie", F.xxhash64("uid", F.lit(5))))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' law", "0 shard", "0L slot", "cast(null as int) grown_shard")
    ranges = max(RANGES, n // RANGE_ROWS)
    # half by bytes, half by count: neither large texts nor very many small ones fill a range
    weight = F.col("size") / total + 1 / F.lit(float(n))
    splitters = Splitters(_quantiles(_sample(rows, weight, SAMPLED * ranges, 0), ranges))
    again = 0
    while True:
        ranged = rows.mapInArrow(_deal(spark.sparkContext.broadcast(splitters)), "range long, " + _KEYED)
        sums = {r[0]: r[1:] for r in ranged.groupBy("range").agg(
            F.sum(weight), F.count("*"), F.sum("size"), F.max(weight)).collect()}
        # what the heaviest record of a range weighs cannot be divided
        overfull = [k for k, (w, c, _, most) in sums.items() if w - most > 2 * 2 / ranges and c > 1]
        if not overfull:
            break
        again += 1
        share = sum(sums[k][0] for k in overfull) / 2
        new, full = [], ranged.filter(F.col("range").isin(overfull))
        by_range: dict[int, list] = {}
        for key, tie, w in _sample(full, weight, max(SAMPLED, int(SAMPLED * ranges * share)), again):
            by_range.setdefault(int(splitters.place(np.array([key]), np.array([tie]))[0]), []).append((key, tie, w))
        for k, sample in by_range.items():
            new += _quantiles(sample, max(2, round(sums[k][0] * ranges / 2)))
        divided = Splitters(splitters.points + new)
        if divided.points == splitters.points:
            break
        splitters = divided
    # `sums` and `ranged` are of the same, last splitters

    table, size_before, rows_before = [], 0, 0
    for k in sorted(sums):
        table.append((k, size_before, rows_before))
        size_before, rows_before = size_before + sums[k][2], rows_before + sums[k][1]
    base = spark.createDataFrame(table, "range long, size_before long, rows_before long")
    order = "PARTITION BY range ORDER BY key, tie, uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = ranged.withColumns({"nth": F.expr(f"count(*) OVER ({order})"), "ends": F.expr(f"sum(size) OVER ({order})")})
    group = "PARTITION BY range, key"
    placed = placed.withColumns({"first": F.expr(f"min(ends - size) OVER ({group})"), "weight": F.expr(f"sum(size) OVER ({group})")})
    share = total / shards
    at = F.col("size_before") + F.when(F.col("weight") <= WHOLE_GROUP * share, F.col("first") + F.col("weight") / 2).otherwise(
        F.col("ends") - F.col("size") / 2)
    placed = checkpoint(placed.join(base, "range").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
        F.least(F.floor(at / share), F.lit(shards - 1)).cast("int").alias("shard")))
    if placed.count() != n:
        raise RuntimeError(f"{placed.count()} of {n} documents were dealt into shards")
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
