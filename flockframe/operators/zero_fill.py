"""The event-by-species grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHUNK = 10_000  # names that one row of the unfolded list holds


def zero_fill(events: DataFrame, obs: DataFrame, species: DataFrame, *, key: str = "checklist_id",
              name: str = "common_name", count: str = "observation_count",
              drop_conflicts: bool = True, chunk: int = CHUNK, number: str = "int") -> DataFrame:
    """Every event with every listed species; a species not reported counts 0.

    The shuffle works on whole checklists: observations are reduced to one short
    list per checklist, joined to the events once, and the grid is unfolded after
    the join, so its rows never cross the network. Checklists with two different
    counts of one species are removed whole when ``drop_conflicts`` is set;
    otherwise such a species gives one row per distinct count.

    The species list is a small table of chunks of about ``chunk`` names (one for most lists), which every
    event meets; null names are no species. The few chunk keys are salted so that the meeting
    is spread over tasks where it is not broadcast.
    """
    listed = species.select(F.col(name)).filter(F.col(name).isNotNull()).distinct()
    chunks, salts = max(1, -(-listed.count() // chunk)), 64
    mine = F.pmod(F.xxhash64(name), F.lit(chunks)).cast("int")
    parts = (listed.groupBy(mine.alias("__chunk")).agg(F.collect_list(name).alias("__every"))
             .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    pairs = _pairs(obs, key, name, count, drop_conflicts, number).join(
        listed.withColumn("__listed", F.lit(True)), name, "left")
    met = (events.join(_checklist_lists(pairs, F.col("__listed"), key, name), key, "left")
           .filter(~F.coalesce(F.col("__conflict"), F.lit(False))).drop("__conflict")
           .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
           .withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
           .join(parts, ["__chunk", "__salt"]))
    here = F.filter(F.coalesce(F.col("__seen"), _no_cells(number)),
                    lambda s: F.pmod(F.xxhash64(s["name"]), F.lit(chunks)) == F.col("__chunk"))
    return _unfold(met.withColumn("__seen", here), name, count, number).drop("__chunk", "__salt")


def kept_events(events: DataFrame, obs: DataFrame, *, key: str = "checklist_id", name: str = "common_name",
                count: str = "observation_count") -> DataFrame:
    """Events without two different counts of one species: those the grid is made of."""
    return events.join(_pairs(obs, key, name, count, True).filter("__conflict").select(key).distinct(), key, "left_anti")


def reported(events: DataFrame, obs: DataFrame, species: DataFrame, *, key: str = "checklist_id",
             name: str = "common_name", count: str = "observation_count") -> DataFrame:
    """The grid's rows of reported listed species, without its zeros: events, name, count."""
    kept = kept_events(events, obs, key=key, name=name, count=count)
    pairs = _pairs(obs, key, name, count, True).select(key, name, F.col("__n").alias(count))
    return kept.join(pairs, key).join(species.select(name).distinct(), name, "left_semi")


def grid_values(events: DataFrame, obs: DataFrame, species: DataFrame, by: list[str], *,
                key: str = "checklist_id", name: str = "common_name", count: str = "observation_count") -> DataFrame:
    """The grid as frequencies: by, name, count, n = its rows with that count.

    Zeros are one row per group and species, found as the group's events less those that
    report the species; the grid itself is never built.
    """
    seen = (reported(events.select(key, *by), obs, species, key=key, name=name, count=count)
            .groupBy(*by, name, count).agg(F.count(F.lit(1)).alias("n")))
    sizes = (kept_events(events.select(key, *by), obs, key=key, name=name, count=count)
             .groupBy(*by).agg(F.count(F.lit(1)).alias("__all")).withColumn("__group", F.struct(*by)))
    number = seen.groupBy(F.struct(*by).alias("__group"), name).agg(F.sum("n").alias("__seen_n"))
    zeros = zero_fill(sizes, number, species, key="__group", name=name, count="__seen_n", drop_conflicts=False,
                      number="bigint").select(
        *by, name, F.lit(0).cast(seen.schema[count].dataType).alias(count), (F.col("__all") - F.col("__seen_n")).alias("n"))
    return seen.unionByName(zeros.filter("n > 0"))


def grid_parts(events: DataFrame, obs: DataFrame, species: DataFrame, by: list[str], *,
               key: str = "checklist_id", name: str = "common_name", count: str = "observation_count"
               ) -> tuple[DataFrame, DataFrame]:
    """The zero-filled grid in two small parts: reported totals and group sizes.

    totals: by, name, total for reported listed species; sizes: by, n = kept events
    of the group. A mean over the grid is sum(total) / sum(n), so the zeros need no
    rows. Conflicting checklists are left out of both.
    """
    own = events.select(key, *by)
    totals = (reported(own, obs, species, key=key, name=name, count=count)
              .groupBy(*by, name).agg(F.sum(count).alias("total")))
    return totals, kept_events(own, obs, key=key, name=name, count=count).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def grid_sums(events: DataFrame, obs: DataFrame, species: DataFrame, by: list[str], *,
              key: str = "checklist_id", name: str = "common_name", count: str = "observation_count") -> DataFrame:
    """Sum ``total`` and number ``n`` over the zero-filled grid, per ``by`` group and species.

    Groups are filled with the absent species after all sums are made, so the grid
    itself is never built.
    """
    totals, sizes = grid_parts(events, obs, species, by, key=key, name=name, count=count)
    totals = totals.filter(F.col("total").isNotNull())
    return zero_fill(sizes.withColumn("__group", F.struct(*by)),
                     totals.select(F.struct(*by).alias("__group"), name, F.col("total").alias("total")),
                     species, key="__group", name=name, count="total", drop_conflicts=False,
                     number="bigint").select(*by, name, "total", "n")


def _pairs(obs, key, name, count, drop_conflicts, number="int"):
    """One row per checklist and species (and distinct count, if conflicts stay)."""
    if drop_conflicts:
        return obs.groupBy(key, name).agg(F.min(count).cast(number).alias("__n"),
                                          (F.min(count) != F.max(count)).alias("__conflict"))
    return obs.select(key, name, F.col(count).cast(number).alias("__n"),
                      F.lit(False).alias("__conflict")).distinct()


def _checklist_lists(pairs, listed, key, name):
    """Per checklist: listed species with their counts, and whether any two counts disagree.

    A conflict in a species outside the list also removes its checklist.
    """
    cell = F.struct(F.col(name).alias("name"), F.col("__n").alias("n"))
    return pairs.groupBy(key).agg(F.collect_list(F.when(listed, cell)).alias("__seen"),
                                  F.max("__conflict").alias("__conflict"))


def _no_cells(number):
    return F.array().cast(f"array<struct<name:string,n:{number}>>")


def _unfold(met, name, count, number):
    """One row per name in ``__every``: those in ``__seen`` with their number, the others with 0."""
    absent = F.transform(F.array_except("__every", F.transform("__seen", lambda s: s["name"])),
                         lambda s: F.struct(s.alias("name"), F.lit(0).cast(number).alias("n")))
    return (met.withColumn("__cell", F.explode(F.concat("__seen", absent))).drop("__seen", "__every")
            .withColumns({name: F.col("__cell.name"), count: F.col("__cell.n")}).drop("__cell"))
