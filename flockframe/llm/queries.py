"""Registered queries of the numbered operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op7_minhash(spark, sf):
    """Near-duplicate components of documents by one-permutation hashing."""
    from .minhash import near_duplicates
    return near_duplicates(_table(spark, sf, "documents"))


#: Text with A-Z in lower case, and its words between ASCII white space.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"""regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"""

ORACLES["op7_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g
      FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION
                SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n"""


@query
def op9_wumanber(spark, sf):
    """Benchmark windows in documents by Wu-Manber search."""
    from .wumanber import decontaminate
    return decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


_ALNUM = f"""regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLES["op9_wumanber"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
sought AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, w[i:i + least(10, len(w)) - 1] AS g
           FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) WHERE len(w) > 0),
places AS (SELECT doc_id, k, i, w[i:i + k - 1] AS g FROM d, (SELECT DISTINCT k FROM sought) k,
             LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
found AS (SELECT doc_id, item_id, i, places.k FROM places JOIN sought ON places.g = sought.g AND places.k = sought.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op10_subwords(spark, sf):
    """Quality of documents by supervised subword embeddings."""
    from .quality import quality
    return quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op6_markov(spark, sf):
    """Secrets in documents: patterns, and runs that Markov models call random."""
    from .secrets import scan
    return scan(_table(spark, sf, "documents"))


@query
def op3_hilbert(spark, sf):
    """Documents packed into sequences along a Hilbert curve."""
    from .packing import pack
    return pack(_table(spark, sf, "documents"))


@query
def op2_ppm(spark, sf):
    """Language of documents by prediction by partial matching."""
    from .ppm import languages
    return languages(_table(spark, sf, "documents"))


@query
def op5_splitters(spark, sf):
    """Documents in eight shards of near equal bytes, by sampled splitters."""
    from .sharding import shard
    return shard(_table(spark, sf, "documents"))


@query
def op8_nndescent(spark, sf):
    """Near-duplicate vectors by NN-descent."""
    from .nndescent import near_vectors
    return near_vectors(_table(spark, sf, "embeddings"))


@query
def op1_gru(spark, sf):
    """Log-likelihood of documents under a gated recurrent language model."""
    from .lm import score
    return score(_table(spark, sf, "documents"))


@query
def op12_matching(spark, sf):
    """Documents packed into few sequences by large-item matching and best fit."""
    from .matching import pack
    return pack(_table(spark, sf, "documents"))


@query
def op13_cholesky(spark, sf):
    """Whitened vectors by shifted Cholesky QR."""
    from .whitening import whiten
    return whiten(_table(spark, sf, "embeddings"))


@query
def op11_bands(spark, sf):
    """Prefix trie of rebuilt conversations by depth-band rollup."""
    from .trie import prefix_trie
    return prefix_trie(_table(spark, sf, "conversations"))


ORACLES["op11_bands"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, count(*) AS n, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, ops),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h FROM bits),
l AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS shared FROM c LEFT JOIN (SELECT conv_id, n FROM c) b ON b.conv_id = c.base),
r AS (SELECT l.conv_id, place AS depth, role, text FROM l JOIN t ON t.conv_id = l.base AND place <= h
      UNION ALL SELECT l.conv_id, place - h + shared, role, text FROM l JOIN t ON t.conv_id = l.conv_id AND place > h),
p AS (SELECT conv_id, depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
        octet_length(encode(text)) AS n_bytes FROM r
      UNION ALL SELECT conv_id, 0, [], 0 FROM l),
m AS (SELECT p.*, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, p.depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
node AS (SELECT node, depth, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, count(*) FILTER (ends) AS n_ends,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM m GROUP BY 1, 2),
up AS (SELECT c.node, c.depth, any_value(d.node) AS parent FROM m c JOIN m d ON d.conv_id = c.conv_id AND d.depth = c.depth - 1 GROUP BY 1, 2),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY 1, 2),
below AS (SELECT m.node, m.depth, sum(CASE WHEN n_ends = n_convs THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b.n_bytes) AS saved
      FROM m JOIN node b ON b.node = m.conv_id AND b.depth >= m.depth GROUP BY 1, 2)
SELECT node.node AS conv_id, node.depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node LEFT JOIN up ON up.node = node.node AND up.depth = node.depth LEFT JOIN kids ON kids.node = node.node AND kids.depth = node.depth
JOIN below ON below.node = node.node AND below.depth = node.depth"""


@query
def op4_tfidf(spark, sf):
    """Licences of documents, laid out in directories by source and thousands and hundreds of the id."""
    from pyspark.sql import functions as F

    from .licenses import scan
    i = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000), F.floor(i / 100), i)
    return scan(_table(spark, sf, "documents").withColumn("path", path))


def _license_sql() -> str:
    from .licenses import LEAST, TEMPLATES

    words = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.][0-9]+)*')"
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text,
      concat_ws('/', coalesce(source, 'none'), doc_id // 1000, doc_id // 100, doc_id) AS path FROM documents),
t AS (SELECT number, name, {words.format('text')} AS words FROM (VALUES {values}) v(number, name, text)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
seen AS (SELECT uid, unnest(list_distinct({words.format('text')})) AS term FROM d),
counts AS (SELECT term, count(*) AS k FROM seen GROUP BY 1),
cut AS (SELECT uid, text, regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), '\\n', ' ', 'g') AS joined FROM d),
parts AS (SELECT row_number() OVER () AS part, uid, kind, {words.format('p')} AS words FROM (
    SELECT uid, 0 AS kind, unnest(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS p FROM cut
    UNION ALL SELECT uid, 1, unnest(string_split(regexp_replace(joined, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1))) FROM cut
    UNION ALL SELECT uid, 2, text FROM cut)),
weights AS (SELECT part, uid, kind, term, tf * (ln((n + 1) / (coalesce(k, 0) + 1)) + 1) AS w FROM (
    SELECT part, uid, kind, term, count(*) AS tf FROM (SELECT part, uid, kind, unnest(words) AS term FROM parts) GROUP BY ALL)
    CROSS JOIN n LEFT JOIN counts USING (term)),
own AS (SELECT number, name, term, tf * (ln((n + 1) / (coalesce(k, 0) + 1)) + 1) AS w FROM (
    SELECT number, name, term, count(*) AS tf FROM (SELECT number, name, unnest(words) AS term FROM t) GROUP BY ALL)
    CROSS JOIN n LEFT JOIN counts USING (term)),
scored AS (SELECT a.uid, a.part, a.kind, o.name, o.number, round(sum(a.w * o.w) / any_value(x.norm) / any_value(y.norm), 6) AS score
    FROM weights a JOIN own o USING (term)
    JOIN (SELECT part, sqrt(sum(w * w)) AS norm FROM weights GROUP BY 1) x ON x.part = a.part
    JOIN (SELECT number, sqrt(sum(w * w)) AS norm FROM own GROUP BY 1) y ON y.number = o.number GROUP BY ALL),
best AS (SELECT uid, part, kind, name, score FROM scored WHERE score >= {LEAST}
         QUALIFY row_number() OVER (PARTITION BY part ORDER BY score DESC, name) = 1),
files AS (SELECT d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, coalesce(k, 0) AS n_statements, b.name AS license, b.score,
      coalesce(near, false) AS is_license_file
    FROM d LEFT JOIN (SELECT uid, count(*) FILTER (kind = 0) AS k, bool_or(kind = 2) AS near FROM best GROUP BY 1) USING (uid)
    LEFT JOIN (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, name) = 1) b USING (uid)),
holders AS (SELECT dir, license FROM files WHERE is_license_file
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (SELECT f.dir, h.license AS inherited, h.dir AS inherited_from,
      CAST(len(string_split(f.dir, '/')) - len(string_split(h.dir, '/')) AS INTEGER) AS distance
    FROM (SELECT DISTINCT dir FROM files) f JOIN holders h ON f.dir = h.dir OR starts_with(f.dir, h.dir || '/')
    QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY len(h.dir) DESC) = 1)
SELECT doc_id, path, n_statements, license, score, is_license_file, inherited, inherited_from, distance,
       coalesce(license, inherited) AS effective
FROM files LEFT JOIN near USING (dir)"""


ORACLES["op4_tfidf"] = _license_sql()
