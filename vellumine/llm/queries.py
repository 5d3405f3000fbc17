"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe_codec, exact_dedup, mixing, pii, simhash, suffix_dedup, token_counts, toxicity, url_reputation
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, queries).withColumn("score", F.round("score", 6))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_chance")})


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_round_trip(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bm25_topk, op2_url_reputation, op3_simhash, op4_token_counts, op5_suffix_dedup, op6_toxicity, op7_bpe_codec, op8_pii, op9_exact_dedup, op10_source_mix)}

_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"


def _level(name: str, rows: str, keys: str, above: str, on: str) -> str:
    """A level of the reputation: its groups, their centre from the level above, the fitted strength and the posterior."""
    return f"""
    {name}_g AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM {rows} GROUP BY {keys}),
    {name}_c AS (SELECT g.*, a.centre FROM {name}_g g JOIN {above} a ON {on}),
    {name}_s AS (SELECT greatest(2.0, least(200.0, coalesce(1 / greatest(1e-9, (sum((bad - n * centre) ** 2) - sum(n * centre * (1 - centre))) / nullif(sum(n * (n - 1) * centre * (1 - centre)), 0)) - 1, 200.0))) AS strength FROM {name}_c),
    {name} AS (SELECT {keys}, strength * centre + bad AS a, strength * (1 - centre) + n - bad AS b, (strength * centre + bad) / (strength + n) AS centre FROM {name}_c, {name}_s)"""


_TWO = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)

ORACLE_SQL: dict[str, str] = {
    "op1_bm25_topk": """
        WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')) AS t FROM documents),
        tf AS (SELECT doc_id, t, count(*) AS c FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(c) AS l FROM tf GROUP BY doc_id),
        st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM dl) / (SELECT count(*) FROM documents) AS av), df AS (SELECT t, count(*) AS f FROM tf GROUP BY t),
        sc AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.c * ln(1 + (n - f + 0.5) / (f + 0.5)) * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * l / av))) AS s
               FROM tf q JOIN tf d ON q.t = d.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = d.doc_id, st WHERE q.doc_id % 50 = 0 GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id)::INT AS rank, doc_id, round(s, 6) AS score FROM sc
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) <= 10""",
    "op2_url_reputation": f"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        lab AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT)::DOUBLE AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max((toxic = 1 OR quality = 0)::INT) IS NOT NULL),
        h AS (SELECT host, count(lab.bad) AS n, coalesce(sum(lab.bad), 0.0) AS bad FROM p LEFT JOIN lab USING (page_id) GROUP BY host),
        bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS x FROM h),
        two AS (SELECT *, array_to_string(x[-2:], '.') IN ({_TWO}) AS double_suffix FROM bare),
        hosts AS (SELECT host, n, bad, CASE WHEN double_suffix THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix, CASE WHEN double_suffix THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain FROM two),
        whole AS (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1), 0.5) AS centre FROM hosts),
        {_level("su", "hosts", "suffix", "whole", "true")},
        {_level("dom", "hosts", "domain, suffix", "su", "a.suffix = g.suffix")},
        {_level("ho", "hosts", "host, domain, suffix", "dom", "a.domain = g.domain AND a.suffix = g.suffix")},
        lim AS (SELECT host, centre AS mean, a, b, {url_reputation.LIFT} * w / (1 - w + {url_reputation.LIFT} * w) AS x FROM ho, (SELECT centre AS w FROM whole)),
        side AS (SELECT host, mean, x > (a + 1) / (a + b + 2) AS turned, CASE WHEN x > (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x, CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS p, CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS q FROM lim),
        ks AS (SELECT host, x, p, q, unnest(range(1, 51 + floor(4 * sqrt(p + q))::BIGINT)) AS m FROM side),
        ds AS (SELECT host, list(CASE WHEN m % 2 = 0 THEN (m // 2) * (q - m // 2) * x / ((p + m - 1) * (p + m)) ELSE -(p + m // 2) * (p + q + m // 2) * x / ((p + 2 * (m // 2)) * (p + 2 * (m // 2) + 1)) END ORDER BY m DESC) AS d FROM ks GROUP BY host),
        cf AS (SELECT host, list_reduce(list_concat([1.0::DOUBLE], d), lambda t, e: 1 + e / t) AS f FROM ds),
        mass AS (SELECT host, mean, turned, exp(p * ln(x) + q * ln(1 - x) + lgamma(p + q) - lgamma(p) - lgamma(q)) / (p * f) AS below FROM side JOIN cf USING (host)),
        r AS (SELECT host, mean, greatest(0.0, least(1.0, CASE WHEN turned THEN below ELSE 1 - below END)) AS chance FROM mass)
        SELECT page_id, host, path,
          CASE WHEN {_FITS.format(h='example.org', p='/en/1')} THEN 'example.org/en/1' WHEN {_FITS.format(h='example.org', p='/es/')} THEN 'example.org/es/' WHEN {_FITS.format(h='com', p='/fr/')} THEN 'com/fr/'
               WHEN {_FITS.format(h='com', p='/de/')} THEN 'com/de/' WHEN {_FITS.format(h='org', p='/')} THEN 'org/' END AS rule,
          CASE WHEN {_FITS.format(h='example.org', p='/en/1')} OR {_FITS.format(h='example.org', p='/es/')} THEN 'block' WHEN {_FITS.format(h='com', p='/fr/')} THEN 'allow' WHEN {_FITS.format(h='com', p='/de/')} THEN 'block'
               WHEN {_FITS.format(h='org', p='/')} THEN 'allow' WHEN chance > {url_reputation.SURE} THEN 'block' ELSE 'allow' END AS verdict,
          round(mean, 6) AS bad_rate, round(chance, 6) AS bad_chance
        FROM p JOIN r USING (host)""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
