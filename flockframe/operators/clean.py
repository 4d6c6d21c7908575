"""Cleaning, harmonising and auditing checklist tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C
from ..session import join_on


def clean_counts(obs: DataFrame, count: str = "observation_count") -> DataFrame:
    """Integer counts; rows with a non-numeric count go."""
    return obs.withColumn(count, C.tolerant_int(F.col(count))).filter(F.col(count).isNotNull())


def exclude_states(df: DataFrame, states, column: str = "state") -> DataFrame:
    """Drop the listed states and keep rows whose state is unknown."""
    return df.filter(C.in_list_or_null(F.col(column), states))


def effort_filter(events: DataFrame, *, protocols=None, season=None, distance_km=None,
                  minutes=None, complete: bool = False) -> DataFrame:
    """Checklist predicates; a missing distance counts as 0 (stationary)."""
    if protocols:
        events = events.filter(F.col("protocol_type").isin(*protocols))
    if season:
        events = events.filter(C.in_season(F.col("observation_date"), *season))
    if distance_km:
        events = events.filter(
            F.coalesce(F.col("effort_distance_km"), F.lit(0.0)).between(*distance_km))
    if minutes:
        events = events.filter(F.col("duration_minutes").between(*minutes))
    if complete:
        events = events.filter(F.col("all_species_reported"))
    return events


def extract_checklists(events: DataFrame, obs: DataFrame, key: str = "checklist_id",
                       **predicates) -> tuple[DataFrame, DataFrame]:
    """One predicate set for both tables, so that they stay aligned."""
    kept = effort_filter(events, **predicates)
    return kept, obs.join(kept.select(key), key, "left_semi")


def collapse_shared(df: DataFrame, *, event_id: str = "checklist_id", group_id: str = "group_id",
                    within: list[str] | None = None) -> DataFrame:
    """One row per shared checklist (and ``within`` columns): the one with the least event id.

    ``min_by`` keeps a single candidate per group in every map task, so a widely
    shared checklist costs no more than any other.
    """
    shared = F.coalesce(F.col(group_id), F.col(event_id).cast("string"))
    keys = ["shared_id", *(within or [])]
    rest = [c for c in df.columns if c not in keys]
    kept = (df.withColumn("shared_id", shared)
            .groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), F.struct(event_id, *rest)).alias("__row")))
    return kept.select(*keys, "__row.*")


def add_event_columns(events: DataFrame) -> DataFrame:
    """Decimal start hour, year, day of year and program label."""
    return events.withColumns({
        "start_hour": C.decimal_hours(F.col("time_observations_started")),
        "year": F.year("observation_date"),
        "day_of_year": F.dayofyear("observation_date"),
        "program": C.program_label(F.col("country_code"), F.col("state_code")),
    })


def between_years(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    return df.filter(F.col(year).between(first, last))


def latest_complete(df: DataFrame, key: list[str], date: str, columns: list[str],
                    tie_break: list[str] | None = None) -> DataFrame:
    """The most recent row per key with no null among ``columns``.

    ``max_by`` is merged on the map side; ties on the date are settled by
    ``tie_break`` and then by the values themselves.
    """
    order = F.struct(date, *(tie_break or []), *columns)
    return (df.dropna(subset=[*key, *columns])
            .groupBy(*key)
            .agg(F.max_by(F.struct(*columns), order).alias("__row"))
            .select(*key, "__row.*"))


def duplicate_combos(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """Unique combinations of ``x`` and ``ys``."""
    return df.select(x, *ys).distinct()


def duplicate_counts(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """Per ``x``: how many combinations there are beyond the first."""
    return (duplicate_combos(df, x, ys).groupBy(x)
            .agg((F.count(F.lit(1)) - 1).alias("n_duplicates")))


def conflicting_keys(obs: DataFrame, key: str = "checklist_id", name: str = "common_name",
                     count: str = "observation_count") -> DataFrame:
    """Checklists that hold two different counts of one species."""
    spread = obs.groupBy(key, name).agg(F.min(count).alias("__lo"), F.max(count).alias("__hi"))
    return spread.filter(F.col("__lo") != F.col("__hi")).select(key).distinct()


def drop_conflicting(events: DataFrame, obs: DataFrame, key: str = "checklist_id",
                     name: str = "common_name", count: str = "observation_count"
                     ) -> tuple[DataFrame, DataFrame]:
    """Remove conflicting checklists whole, from both tables; observations come out distinct."""
    bad = conflicting_keys(obs, key, name, count)
    return (events.join(bad, key, "left_anti"),
            obs.select(key, name, count).distinct().join(bad, key, "left_anti"))


def unmatched_names(names: DataFrame, reference: DataFrame, name: str, fixes: DataFrame | None = None
                    ) -> DataFrame:
    """Names without a match in ``reference`` after replacing names by ``fixes(from, to)``."""
    return names.select(name).distinct().join(
        reconcile_names(reference, name, fixes).select(name), name, "left_anti")


def reconcile_names(df: DataFrame, name: str, fixes: DataFrame | None) -> DataFrame:
    """Replace names listed in ``fixes(from, to)``."""
    if fixes is None:
        return df
    patch = fixes.select(F.col("from").alias(name), F.col("to").alias("__to"))
    return (df.join(patch, name, "left")
            .withColumn(name, F.coalesce("__to", name)).drop("__to"))


def harmonise_workbook(raw: DataFrame, *, country_code: str, country: str, protocol: str,
                       months: tuple[int, int] = (7, 11)) -> DataFrame:
    """Second-program rows under the names and types of the first program.

    ``raw``: survey_code, site_code, survey_site, species, ob_count, day, month,
    year, time_start, time_end, province, observer_no, latitude, longitude.
    """
    hours, mins = F.hour("time_start"), F.minute("time_start")
    observer = F.concat(F.lit("OB_"), F.col("observer_no"))
    return raw.filter(F.col("month").between(*months)).select(
        C.composite_key(F.col("survey_code"), F.col("site_code"), F.col("day"), F.col("month"),
                        F.col("year"), hours, mins, observer).alias("checklist_id"),
        F.col("site_code").alias("locality_id"),
        F.col("survey_site").alias("locality"),
        C.date_from_parts(F.col("day"), F.col("month"), F.col("year")).alias("observation_date"),
        F.col("species").alias("common_name"),
        C.tolerant_int(F.col("ob_count")).alias("observation_count"),
        F.col("latitude"), F.col("longitude"),
        F.format_string("%dH %dM 0S", hours, mins).alias("time_observations_started"),
        F.lit(country_code).alias("country_code"), F.lit(country).alias("country"),
        F.concat(F.lit(country_code + "-"), F.col("province")).alias("state_code"),
        observer.alias("observer_id"), F.lit(protocol).alias("protocol_type"),
        C.minutes_between(F.col("time_start"), F.col("time_end")).alias("duration_minutes"),
    ).filter(F.col("observation_count").isNotNull())


def split_events(combined: DataFrame, event_columns: list[str], key: str = "checklist_id"
                 ) -> tuple[DataFrame, DataFrame]:
    """Combined table -> distinct event rows, and observation rows without event columns."""
    events = combined.select(key, *event_columns).distinct()
    return events, combined.drop(*event_columns)


def replace_slice(source: DataFrame, other: DataFrame, drop_states, column: str = "state") -> DataFrame:
    """Drop the listed states from ``source`` and append ``other``; absent columns are null."""
    return exclude_states(source, drop_states, column).unionByName(other, allowMissingColumns=True)


def canonical_sites(df: DataFrame, sites: DataFrame, key: str = "locality_id") -> DataFrame:
    """Replace site attributes by those of the canonical table; unlisted sites go."""
    shared = [c for c in sites.columns if c != key and c in df.columns]
    return df.drop(*shared).join(sites, key)


def share_where(df: DataFrame, keys: list[str], cond: Column, name: str = "share") -> DataFrame:
    """Share of rows that satisfy ``cond``, per key; unknown counts as no."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(cond) / F.count(F.lit(1))).alias(name))


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all shared columns; a missing key value matches a missing one."""
    return join_on(left, right, [c for c in left.columns if c in right.columns], how)
