"""Scalar helpers: every function takes and returns Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; keeps long formulas from multiplying."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- text, dates and counts ---------------------------------------------------


def tolerant_int(c: Column) -> Column:
    """Integer part of a numeric text; null for anything else ("X", "present", "5d")."""
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return F.when(c.cast("string").rlike(number), c.try_cast("double").try_cast("int"))


def composite_key(*cols: Column, sep: str = "_") -> Column:
    """Join values with ``sep``; a missing value is rendered as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def in_list_or_null(c: Column, values) -> Column:
    """True where ``c`` is outside ``values``, also when it is unknown."""
    return ~c.isin(*values) | c.isNull()


def decimal_hours(text: Column) -> Column:
    """Hours since midnight from ``08:30:15`` or ``8H 30M 15S``; null otherwise.

    A clock time with 60 or more minutes, or more than 60 seconds (a leap second), is none.
    """
    number = r"([0-9]+(?:\.[0-9]+)?)"

    def unit(letter):
        return F.coalesce(F.regexp_extract(text, number + letter, 1).try_cast("double"), F.lit(0.0))

    parts = F.regexp_extract_all(text, F.lit(number), F.lit(1))

    def part(i):
        return F.get(parts, F.lit(i)).try_cast("double")

    return (F.when(text.rlike(r"[0-9]\s*[HMS]"), unit("H") + unit("M") / 60 + unit("S") / 3600)
            .when((F.size(parts) >= 3) & (part(1) < 60) & (part(2) <= 60),
                  part(0) + part(1) / 60 + part(2) / 3600))


def in_season(date: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Year-agnostic (month, day) window, both ends included; may wrap the year end."""
    md = F.month(date) * 100 + F.dayofmonth(date)
    lo, hi = first[0] * 100 + first[1], last[0] * 100 + last[1]
    return md.between(lo, hi) if lo <= hi else (md >= lo) | (md <= hi)


def date_from_parts(day: Column, month: Column, year: Column) -> Column:
    """Date from day, month, year; null for impossible dates."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.try_to_date(text, "yyyy-MM-dd")


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end`` timestamps."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(60.0)


def name_slug(c: Column) -> Column:
    """File-safe name: spaces become underscores, apostrophes go."""
    return F.translate(c, " '", "_")


def rename_quantile(name: str) -> str:
    """``2.5%`` -> ``PI2_5``."""
    return "PI" + name.rstrip("%").replace(".", "_") if name.endswith("%") else name


# --- classification -----------------------------------------------------------


def program_label(country_code: Column, state_code: Column) -> Column:
    """Survey program from country and state codes; later rules win."""
    atlantic = ["CA-NS", "CA-PE", "CA-NB", "CA-NL"]
    return (F.when(state_code.isin(atlantic), "ACSS")
            .when(state_code == "CA-ON", "OSS")
            .when(country_code == "US", "ISS")
            .otherwise("Canada_other"))


def stage_label(year: Column, end_year: Column, three_gen: Column) -> Column:
    """recent / previous / earlier spans of three generations counted from the end."""
    age = end_year - year
    return F.when(age <= three_gen, "recent").when(age <= 2 * three_gen, "previous").otherwise("earlier")


def probability_class(p: Column, threshold: float = 0.85) -> Column:
    """Three-way class of a probability of being negative."""
    pct = f"{threshold * 100:g}%"
    return (F.when(p > threshold, f"> {pct} probability negative")
            .when(p < 1 - threshold, f"> {pct} probability positive")
            .when(p.isNotNull(), f"< {pct} probability of change"))


# Class limits of the two trend map legends (fixed values).
TREND_BREAKS = (-7, -4, -2, -1, -0.5, 0.5, 1, 2, 4, 7)
TREND_BREAKS_FINE = (-2.5, -1.5, -1, -0.5, -0.25, 0.25, 0.5, 1, 1.5, 2.5)


def bin_labels(breaks=TREND_BREAKS) -> list[str]:
    inner = [f"{a:g}:{b:g} %" for a, b in zip(breaks, breaks[1:])]
    return [f"< {breaks[0]:g} %", *inner, f"> {breaks[-1]:g} %"]


def trend_bin(c: Column, breaks=TREND_BREAKS) -> Column:
    """Legend label of a trend; classes are closed on the right."""
    labels = bin_labels(breaks)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(breaks, labels):
        out = out.when(c <= float(limit), label)
    return out.otherwise(labels[-1])


def bin_ordinal(c: Column, breaks=TREND_BREAKS) -> Column:
    """Position of the legend class, 1 = most negative."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, limit in enumerate(breaks, 1):
        out = out.when(c <= float(limit), i)
    return out.otherwise(len(breaks) + 1)


def trend_annotation(change: Column, start: Column, end: Column, low: Column, high: Column) -> Column:
    """``-12.3 %  1980 : 2024 [ -20  :  1 ]`` with three significant digits."""
    def num(c):
        return F.regexp_replace(signif(c, 3).cast("string"), r"\.0$", "")
    return F.concat(num(change), F.lit(" %  "), start.cast("string"), F.lit(" : "), end.cast("string"),
                    F.lit(" [ "), num(low), F.lit("  :  "), num(high), F.lit(" ]"))


# --- rates --------------------------------------------------------------------


def ratio(start: Column, end: Column) -> Column:
    """end / start, null unless start is positive and end is not negative."""
    return F.when((start > 0) & (end >= 0), F.try_divide(end, start))


def annual_rate(r: Column, years: Column) -> Column:
    """Mean percent change per year behind a ratio over ``years`` years."""
    return F.when(r >= 0, (F.pow(r, F.try_divide(F.lit(1.0), years)) - 1) * 100)


def percent_change(r: Column) -> Column:
    return (r - 1) * 100


def slope_percent(b: Column) -> Column:
    """Percent change per unit of a log-scale slope."""
    return (F.exp(b) - 1) * 100


def three_generations(gen_length: Column, least: int = 10) -> Column:
    return F.greatest(F.lit(least), F.ceil(gen_length * 3).cast("int"))


def signif(c: Column, digits: int = 3) -> Column:
    """Round to significant digits; zero stays zero."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(F.round(F.try_divide(c, step)) * step, 10))


# --- special functions --------------------------------------------------------


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0: Stirling's series at x + 8, stepped back by the recurrence."""
    z = x + 8.0
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    series = (1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
              - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0))))
    return F.when(x > 0, (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shift))


def poisson_loglik(count: Column, log_mean: Column) -> Column:
    n = count.cast("double")
    return n * log_mean - F.exp(log_mean) - lgamma(n + 1.0)


def negbinom_loglik(count: Column, log_mean: Column, phi: Column) -> Column:
    """Negative binomial with mean exp(log_mean) and variance mu + mu^2/phi."""
    n = count.cast("double")
    total = F.log(F.exp(log_mean) + phi)
    return (lgamma(n + phi) - lgamma(phi) - lgamma(n + 1.0)
            + n * (log_mean - total) + phi * (F.log(phi) - total))


def digest_number(*cols: Column) -> Column:
    """Deterministic whole number below 2^52: the first 13 hexadecimal digits of the MD5 of the columns' texts, joined by ``|``.

    Any database with MD5 computes the same, so samples can be drawn and checked elsewhere. Nulls are left out of the text.
    """
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def unit_hash(*cols: Column) -> Column:
    """Deterministic uniform number in [0, 1) from the column values (see ``digest_number``)."""
    return digest_number(*cols).cast("double") / float(1 << 52)


def poisson_one(u: Column, terms: int = 18) -> Column:
    """Poisson(1) quantile of a uniform number."""
    cdf, p, total = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(terms):
        cdf += p
        p /= k + 1
        total = total + (u >= cdf).cast("int")
    return total


# Coefficients of Wichura's normal quantile approximation AS 241 (fixed values):
# numerator and denominator for the middle, the near tails and the far tails, low powers first.
_AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of 0 < p < 1."""
    def rational(part, x):
        top, bottom = (F.lit(c[-1]) for c in part)
        for a, b in zip(part[0][-2::-1], part[1][-2::-1]):
            top, bottom = top * x + a, bottom * x + b
        return top / bottom

    middle, near, far = _AS241

    def scores(v):
        q, tail = v["q"], v["tail"]
        outer = F.when(tail <= 5, rational(near, tail - 1.6)).otherwise(rational(far, tail - 5.0))
        return F.when(F.abs(q) <= 0.425, q * rational(middle, 0.180625 - q * q)).otherwise(
            F.signum(q) * outer)

    inside = F.when((p > 0) & (p < 1), p)
    return bind(F.struct((inside - 0.5).alias("q"),
                         F.sqrt(-F.log(F.least(inside, 1 - inside))).alias("tail")), scores)
