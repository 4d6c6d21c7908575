"""Coverage filters, integer codes and effort summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as C
from ..functions.aggregates import quantile
from ..session import checkpoint, join_on

def spans(surveys: DataFrame, keys: list[str], year: str = "year", count: str = "count",
          weight: str | None = None) -> DataFrame:
    """Years with non-zero counts per key: number, span, first and last.

    ``weight`` is the number of non-zero observations behind a row, if rows are sums.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (surveys.filter(F.col(count) > 0)
            .groupBy(*keys, year).agg(number.alias("nobs"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("nyears"),
                 (F.max(year) - F.min(year)).alias("span_years"),
                 F.min(year).alias("fyear"), F.max(year).alias("lyear"),
                 F.sum("nobs").alias("nobs")))


def site_coverage(surveys: DataFrame, min_span: int = 10, min_years: int = 2,
                  site: str = "site_id", **columns) -> DataFrame:
    """Species-site pairs seen over at least ``min_span`` years."""
    return spans(surveys, ["species", site], **columns).filter(
        (F.col("span_years") >= min_span) & (F.col("nyears") >= min_years))


def stratum_coverage(surveys: DataFrame, first_year: int, last_year: int, share: float = 0.67,
                     stratum: str = "hex_name", **columns) -> DataFrame:
    """Species-stratum pairs whose sightings span a share of the study years."""
    need = (last_year - first_year + 1) * share
    return spans(surveys, ["species", stratum], **columns).filter(F.col("span_years") >= need)


def keep_covered(surveys: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    return surveys.join(covered.select(*keys), keys, "left_semi")


def group_category(df: DataFrame, keys: list[str], value: str, which: str = "least",
                   weight: str | None = None) -> DataFrame:
    """One value per group: the least frequent one, or with ``which="most"`` the dominant one.

    The least frequent is what the method this follows returns; ties go to the
    alphabetically first value in both cases. ``weight`` is the number of surveys
    behind a row, if rows are sums.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(number.alias("__n"))
    order = F.col("__n") if which == "least" else -F.col("__n")
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(order.alias("n"), F.col(value))).alias(value))


def dense_codes(df: DataFrame, keys: list[str], value: str, code: str = "code") -> DataFrame:
    """Distinct values per group numbered 1, 2, ... in sorted order; null values get none.

    They are range-sorted over the cluster and numbered by partition offset plus position;
    the sorted table is checkpointed first, so the numbers hold when tasks rerun. Codes are
    integers: a group of more than 2^31 values fails in the cast.
    """
    domain = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = checkpoint(domain.orderBy(*keys, value).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    # one row per partition of the sorted table
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(F.lit(1)).orderBy("__part")
    offsets = sizes.select("__part", (F.sum("__size").over(before) - F.col("__size")).alias("__off"))
    placed = (ranked.withColumn("__part", part).join(offsets, "__part")
              .withColumn("__pos", F.col("__off") + place))
    if not keys:
        return placed.select(value, (F.col("__pos") + 1).cast("int").alias(code))
    first = placed.groupBy(*keys).agg(F.min("__pos").alias("__first"))
    return join_on(placed, first, keys).select(
        *keys, value, (F.col("__pos") - F.col("__first") + 1).cast("int").alias(code))


def code_table(surveys: DataFrame, site: str = "site_id", stratum: str = "hex_name") -> DataFrame:
    """species, site and stratum with their integer codes and the species' first year and day."""
    cells = checkpoint(surveys.groupBy("species", site, stratum).agg(
        (F.min("year") - 1).alias("__year0"), (F.min("doy") - 1).alias("__day0"),
        F.max("year").alias("__last")))
    base = cells.groupBy("species").agg(
        F.min("__year0").alias("__year0"), F.min("__day0").alias("__day0"),
        F.floor((F.max("__last") - F.min("__year0")) / 2).alias("__mid"))
    return (cells.select("species", site, stratum)
            .join(dense_codes(cells, ["species"], site, "site"), ["species", site])
            .join(dense_codes(cells, ["species"], stratum, "strat"), ["species", stratum])
            .join(base, "species"))


def index_encode(surveys: DataFrame, site: str = "site_id", stratum: str = "hex_name") -> DataFrame:
    """Add integer yr, date, site and strat codes per species, all starting at 1,
    and ``yr_centred``, the year counted from the middle of the species' series.

    The codes come from the distinct species-site-stratum triples and meet the
    surveys in one join.
    """
    return (surveys.join(code_table(surveys, site, stratum), ["species", site, stratum])
            .withColumn("yr", (F.col("year") - F.col("__year0")).cast("int"))
            .withColumn("yr_centred", (F.col("yr") - F.col("__mid")).cast("int"))
            .withColumn("date", (F.col("doy") - F.col("__day0")).cast("int"))
            .drop("__year0", "__day0", "__mid"))


def model_sizes(encoded: DataFrame) -> DataFrame:
    """Numbers of years, strata, sites, counts, days and the longest site list per species."""
    lists = (encoded.select("species", "strat", "site").distinct()
             .groupBy("species", "strat").agg(F.count(F.lit(1)).alias("__k"))
             .groupBy("species").agg(F.max("__k").alias("max_sites")))
    return (encoded.groupBy("species").agg(
        F.max("yr").alias("nyears"), F.max("strat").alias("nstrata"), F.max("site").alias("nsites"),
        F.count(F.lit(1)).alias("ncounts"), F.max("date").alias("ndays")).join(lists, "species"))


def sites_by_stratum(encoded: DataFrame) -> DataFrame:
    """Long form of the site lists: species, strat, slot, site and the list length.

    Long instead of one array per stratum, so a stratum of any size is spread
    over rows; ``slot`` is the position of the site in its stratum's list.
    """
    pairs = encoded.select("species", "strat", "site").distinct()
    slots = dense_codes(pairs, ["species", "strat"], "site", "slot")
    sizes = pairs.groupBy("species", "strat").agg(F.count(F.lit(1)).alias("n_sites"))
    return slots.join(sizes, ["species", "strat"])


def unroll_sites(lists: DataFrame, column: str = "sites") -> DataFrame:
    """Zero-padded site lists, one array per stratum -> species, strat, slot, site."""
    return (lists.select("species", "strat", F.posexplode(column).alias("slot", "site"))
            .withColumn("slot", F.col("slot") + 1).filter(F.col("site") > 0))


def season_strata(strat_regions: DataFrame, species_list: DataFrame) -> DataFrame:
    """Season group per species and stratum: 2 where the region has the other season.

    ``species_list``: species, two_seasons, regions_w_alt_season (" - " between names).
    """
    alt = F.split("regions_w_alt_season", " - ")
    other = F.coalesce(F.col("two_seasons") & F.array_contains(alt, F.col("region")), F.lit(False))
    return (strat_regions.join(species_list, "species", "left")
            .withColumn("seas_strat", F.when(other, 2).otherwise(1))
            .select(*strat_regions.columns, "seas_strat"))


def survey_effort(events: DataFrame, region: str = "region", site: str = "locality_id",
                  key: str = "checklist_id") -> DataFrame:
    """Sites, surveys and the 95 % quantile of surveys per site, by region.

    Checklists are made distinct and counted per site first; the quantile then
    runs over the few distinct survey counts.
    """
    per_site = (events.select(region, site, key).distinct()
                .groupBy(region, site).agg(F.count(F.lit(1)).alias("__n")))
    return per_site.groupBy(region).agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("__n").alias("n_surveys"),
        quantile(F.col("__n").cast("double"), 0.95).alias("q95_surveys"))


def site_year_means(surveys: DataFrame, site: str = "site_id", weight: str | None = None) -> DataFrame:
    """log(mean count + 1) per species, site and year; ``weight``: surveys behind a row, if rows are values."""
    w = F.lit(1) if weight is None else F.col(weight)
    known = F.sum(F.when(F.col("count").isNotNull(), w))
    return surveys.groupBy("species", site, "year").agg(
        F.log1p(F.try_divide(F.sum(F.col("count") * w), known)).alias("log_mean"))


def zero_bird_surveys(events: DataFrame, obs: DataFrame, key: str = "checklist_id",
                      count: str = "observation_count") -> DataFrame:
    """Checklists by the total number of birds reported (0 where none)."""
    totals = obs.groupBy(key).agg(F.sum(count).cast("bigint").alias("__t"))
    return (events.select(key).distinct().join(totals, key, "left")
            .groupBy(F.coalesce("__t", F.lit(0)).cast("bigint").alias("total_birds"))
            .agg(F.count(F.lit(1)).alias("n_checklists")))


def group_sample(df: DataFrame, group: list[str], ids: list[str], share: float, seed: int = 0
                 ) -> DataFrame:
    """Exactly floor(share * n) rows of every group: those of the least digests of ``seed`` and ``ids`` (``digest_number``).

    Rows fall into 4096 bins of digests per group; bins below the quota are taken whole
    and only the one bin at the border is ordered, so large groups stay spread.
    """
    keys = [*group, "__bin"]
    rows = df.withColumn("__h", C.digest_number(F.lit(seed), *[F.col(i) for i in ids]))
    rows = rows.withColumn("__bin", F.shiftright("__h", 40).cast("int"))
    by_bin = Window.partitionBy(*group).orderBy("__bin")
    bins = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__bn"))
            .withColumn("__upto", F.sum("__bn").over(by_bin))
            .withColumn("__quota", F.floor(F.sum("__bn").over(Window.partitionBy(*group)) * share))
            .withColumn("__need", F.col("__quota") - F.col("__upto") + F.col("__bn"))
            .filter(F.col("__need") > 0))
    picked = join_on(rows, bins.select(*keys, "__need", "__bn"), keys)
    whole = picked.filter(F.col("__need") >= F.col("__bn"))
    edge = (picked.filter(F.col("__need") < F.col("__bn"))
            .withColumn("__rn", F.row_number().over(
                Window.partitionBy(*keys).orderBy("__h", *ids)))
            .filter(F.col("__rn") <= F.col("__need")))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))
