"""Secrets in texts: patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame and SQL functions only. Positions come from splitting a text at its matches: what lies
between them and the matches themselves add up to code-point offsets.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint
from . import text as X

#: Kinds in the order they are listed, with their patterns. Fixed values.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
#: What the Markov models judge: whole runs of these characters with a digit and a letter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
_WORD = r"[A-Za-z_][A-Za-z0-9_-]{5,}+"
_KINDS = [*PATTERNS, "markov"]
_LEAST_VALUE = 8
MASK = "[SECRET]"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _matches(pattern: str, group: int = 0) -> Column:
    return F.expr(f"regexp_extract_all(text, {_quoted(pattern)}, {group})")


def _between(pattern: str, matches: str) -> Column:
    """The texts before each match, and after the last; null without matches."""
    return F.when(F.size(matches) > 0, F.expr(f"split(text, {_quoted(pattern)}, -1)"))


# --- the models --------------------------------------------------------------------------------------

def samples(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """(string, secret): labelled strings from about ``rows`` documents, taken by a hash of the id.

    Random strings are hashes of the ids as hexadecimal, base 64 and capitals, and what the patterns find;
    ordinary ones are the words of texts without a find, as they stand and in capitals.
    """
    n = docs.count()
    share = min(1.0, rows / max(1, n))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 30))
    taken = X.documents(docs.filter(place < math.ceil(share * (1 << 30))), "doc_id")
    any_ = "|".join(f"(?:{p})" for p in PATTERNS.values())
    taken = taken.withColumn("finds", _matches(any_))
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    code = F.base64(F.unhex(digest))
    made = taken.select(F.explode(F.concat(
        F.array(digest, code, F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")), F.col("finds"))).alias("string"))
    words = taken.filter(F.size("finds") == 0).select(F.explode(_matches(_WORD)).alias("w"))
    words = words.select(F.explode(F.array("w", F.upper("w"))).alias("string"))
    return made.withColumn("secret", F.lit(True)).union(words.withColumn("secret", F.lit(False)))


def train(strings: DataFrame) -> list[float]:
    """Log ratio of the two models' transition probabilities, character by character of ``ALPHABET``.

    Counts of pairs are aggregated by Spark; at most two for each pair of characters come back. Each
    transition has half a count more; without samples all ratios are 0.
    """
    pair = F.explode(F.expr("transform(sequence(1, greatest(length(string) - 1, 1)), i -> substring(string, i, 2))"))
    counts = (strings.groupBy("string", "secret").agg(F.count("*").alias("k")).select("secret", "k", pair.alias("pair"))
              .filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
              .groupBy("secret", "pair").agg(F.sum("k").alias("k")).collect())
    size = len(ALPHABET)
    logs = {}
    for secret in (True, False):
        own = {r["pair"]: r["k"] for r in counts if r["secret"] is secret}
        total = {a: sum(own.get(a + b, 0) for b in ALPHABET) + size / 2 for a in ALPHABET}
        logs[secret] = [math.log((own.get(a + b, 0) + 0.5) / total[a]) for a in ALPHABET for b in ALPHABET]
    return [round(x - y, 9) for x, y in zip(logs[True], logs[False])]


def _ratio(model: list[float], string: Column) -> Column:
    """Mean log-likelihood ratio of a string's transitions."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))
    step = lambda total, i: total + F.get(table, (at(i - 1) - 1) * len(ALPHABET) + at(i) - 1)
    return F.aggregate(F.sequence(F.lit(2), F.length(string)), F.lit(0.0), step) / (F.length(string) - 1)


def _is_random(model: list[float], string: Column, least: float) -> Column:
    return F.when(string.rlike("[0-9]") & string.rlike("[A-Za-z]"), _ratio(model, string) >= least).otherwise(False)


# --- spans -------------------------------------------------------------------------------------------

def _marks(kind: str) -> Column:
    """Matches of a kind in order: code points since the last one, own length, and the string to judge."""
    value = F.col("assign_values" if kind == "assign" else kind)
    pairs = F.zip_with(F.slice(F.col(f"{kind}_gaps"), F.lit(1), F.size(kind)), F.col(kind),
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    mark = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x["p"]["gap"].alias("gap"),
                                 x["p"]["len"].alias("len"), x["v"].alias("value"))
    none = F.array().cast("array<struct<kind:string,place:int,gap:int,len:int,value:string>>")
    return F.when(F.size(kind) > 0, F.transform(F.arrays_zip(pairs.alias("p"), value.alias("v")), mark)).otherwise(none)


def find_spans(docs: DataFrame, model: list[float], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, doc_id) of all documents and spans (uid, kind, start, end): code points, end exclusive."""
    rows = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"))
    patterns = PATTERNS | {"markov": _RUN}
    rows = rows.withColumns({k: _matches(p) for k, p in patterns.items()})
    rows = rows.withColumns({f"{k}_gaps": _between(p, k) for k, p in patterns.items()}
                            | {"assign_values": F.when(F.size("assign") > 0, _matches(PATTERNS["assign"], 2))})
    marks = [_marks(kind) for kind in patterns]
    found = checkpoint(rows.select("uid", "doc_id", F.concat(*marks).alias("marks")))
    each = found.select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    good = (F.when(F.col("kind") == "assign", F.length("value") >= _LEAST_VALUE)
            .when(F.col("kind") == "markov", _is_random(model, F.col("value"), least)).otherwise(True))
    end = F.expr("sum(gap + len) OVER (PARTITION BY uid, kind ORDER BY place)")
    spans = each.withColumn("end", end).filter(good).select(
        "uid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    # what the patterns found already is not found again: the latest end so far and the next start tell
    order = "OVER (PARTITION BY uid ORDER BY start, end"
    base = "CASE WHEN kind <> 'markov' THEN {} END"
    spans = spans.withColumns({
        "before": F.expr(f"max({base.format('end')}) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        "after": F.expr(f"min({base.format('start')}) {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")})
    free = (F.coalesce(F.col("before"), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.col("after"), F.col("end")) >= F.col("end"))
    return found.select("uid", "doc_id"), spans.filter((F.col("kind") != "markov") | free).select("uid", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None, least: float = 0.5) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Matches are leftmost and non-overlapping for each kind. A run of 20 or more characters with digits and letters, outside the
    patterns' spans, is added as ``markov`` if its mean log-likelihood ratio is ``least`` or more under ``model``
    (by default trained on a bounded sample of ``docs``). Any number of spans in a document is kept.

    Null and empty texts have no spans. Repeated documents each get their row; a null id stays null. Other
    columns are not looked at; an empty table gives no rows.
    """
    if model is None:
        model = train(samples(docs))
    rows, spans = find_spans(docs, model, least)
    rank = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind")).cast("int") - 1
    found = spans.withColumn("rank", rank).groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in _KINDS],
        F.collect_list(F.when(F.col("kind") != "markov", F.struct("start", "rank", "end"))).alias("base"),
        F.collect_list(F.struct("start", "rank", "end")).alias("all"))
    found = found.select("uid", *[f"n_{k}" for k in _KINDS], _joined(F.col("base")).alias("base"),
                         _joined(F.col("all")).alias("spans"))
    joined = rows.join(found, "uid", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in _KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def mask(docs: DataFrame, model: list[float] | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by [SECRET], ``n_chars`` (if there) as the new length.

    The kinds are taken in turn, each on what the one before left. Texts without secrets, nulls too, stay as they are.
    """
    if model is None:
        model = train(samples(docs))
    out = docs
    for kind, pattern in (PATTERNS | {"markov": _RUN}).items():
        group = 2 if kind == "assign" else 0
        good = {"assign": lambda v: F.length(v) >= _LEAST_VALUE,
                "markov": lambda v: _is_random(model, v, least)}.get(kind, lambda v: F.lit(True))
        out = out.withColumn("__found", F.coalesce(_matches(pattern), F.array().cast("array<string>")))
        out = out.withColumn("__gaps", _between(pattern, "__found"))
        keep = F.transform(_matches(pattern, group), good)
        parts = F.zip_with(F.zip_with(F.col("__found"), keep, lambda m, g: F.when(g, F.lit(MASK)).otherwise(m)),
                           F.slice(F.col("__gaps"), F.lit(2), F.size("__found")), lambda m, after: F.concat(m, after))
        new = F.concat(F.get("__gaps", F.lit(0)), F.array_join(parts, ""))
        out = out.withColumn("text", F.when(F.size("__found") > 0, new).otherwise(F.col("text"))).drop("__found", "__gaps")
    if "n_chars" in docs.columns:
        changed = F.col("text").contains(MASK)
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
