import pytest

from flockframe.operators import clean
from flockframe.operators.zero_fill import zero_fill


@pytest.fixture()
def tables(spark):
    events = spark.createDataFrame([(i, i % 3) for i in range(8)] + [(None, 9)], "checklist_id long, site long")
    obs = spark.createDataFrame(
        [(0, "a", 3), (0, "a", 3), (0, "b", 1), (1, "a", 2), (1, "a", 5), (2, "z", 7), (3, "c", 4), (99, "a", 1),
         (4, "z", 1), (4, "z", 2)],
        "checklist_id long, common_name string, observation_count int")
    species = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "common_name string")
    return events, obs, species


def plain(events, obs, species, drop=True):
    """The definition: every kept event with every listed name."""
    ev = [tuple(r) for r in events.collect()]
    ob = {tuple(r) for r in obs.collect()}
    names = sorted({r[0] for r in species.collect()})
    counts = {}
    for k, n, c in ob:
        counts.setdefault((k, n), set()).add(c)
    bad = {k for (k, n), c in counts.items() if len(c) > 1} if drop else set()
    return sorted(((k, s, n, c) for k, s in ev if k not in bad for n in names
                   for c in sorted(counts.get((k, n), {0}))), key=str)


@pytest.mark.parametrize("drop", [True, False])
@pytest.mark.parametrize("bound", [10, 1])
def test_matches_definition(tables, drop, bound):
    got = zero_fill(*tables, drop_conflicts=drop, chunk=bound)
    assert got.columns == ["checklist_id", "site", "common_name", "observation_count"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(*tables, drop=drop)


def test_chunked_list_gives_the_same_rows(tables):
    events, obs, species = tables
    a, b = (sorted(map(str, zero_fill(events, obs, species, chunk=n).collect())) for n in (10, 1))
    assert a == b


def test_size_is_events_times_species(tables):
    events, obs, species = tables
    kept, _ = clean.drop_conflicting(events, obs)
    assert zero_fill(events, obs, species).count() == kept.count() * 3


def test_grid_rows_are_not_shuffled(tables):
    plan = zero_fill(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join"), "unfolding must come after the join"


def test_conflict_outside_the_list_drops_the_checklist(tables):
    kept = {r[0] for r in zero_fill(*tables).select("checklist_id").collect()}
    assert 4 not in kept and 1 not in kept and 0 in kept


def test_empty_species_list(tables):
    events, obs, species = tables
    assert zero_fill(events, obs, species.limit(0)).isEmpty()
