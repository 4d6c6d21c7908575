"""Texts of near sites: as the long form tells them, in crowded cells too, and without a shuffle of all members."""

import random

import pytest
from pyspark.sql import functions as F
from test_pointwise import shuffled

from flockframe.operators import spatial


def crowd(spark, n, great_circle=False, crowded=60):
    r = random.Random(11)
    spots = [(r.uniform(0, 2), r.uniform(0, 2)) for _ in range(crowded)] + [(r.uniform(-40, 40), r.uniform(-40, 40)) for _ in range(30)]
    data = [(k, None if k % 7 == 0 else f"s{k}", *spots[r.randrange(len(spots))]) for k in range(n)]
    data += [(n, "lost", None, 1.0), (n + 1, "lost", float("nan"), 1.0), (3, "twice", *spots[0]), (None, "nobody", *spots[0])]
    at = ("longitude", "latitude") if great_circle else ("x", "y")
    return spark.createDataFrame(data, f"locality_id long, name string, {at[0]} double, {at[1]} double"), at


@pytest.mark.parametrize("hot", [2000, 5])
@pytest.mark.parametrize("great_circle", [False, True])
def test_texts_are_the_long_form(spark, hot, great_circle):
    sites, at = crowd(spark, 200, great_circle)
    reach = 120_000.0 if great_circle else 1.0
    got = spatial.near_sites(sites, reach, name="name", great_circle=great_circle, hot=hot)
    assert got.columns == [*sites.columns, "n_near", "near_ids", "near_names"]
    members = spatial.near_members(sites, reach, great_circle=great_circle, name="name")
    lists = members.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("id2", "name2"))).alias("m"))
    want = sites.join(lists, list(at)).collect()
    texts = sorted((str(r.locality_id), r.name, len(r.m), "-".join(str(m.id2) for m in r.m if m.id2 is not None),
                    "-".join(m.name2 or "NA" for m in r.m)) for r in want if r[at[0]] == r[at[0]])
    assert sorted((str(r.locality_id), r.name, r.n_near, r.near_ids, r.near_names) for r in got.collect()) == texts
    assert len(texts) == 202


def test_members_are_not_shuffled(spark):
    sites, _ = crowd(spark, 8000, crowded=400)
    n = spatial.near_members(sites, 1.0).count()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffled(spatial.near_sites(sites, 1.0, name="name"), "dataSize") < 16 * n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
