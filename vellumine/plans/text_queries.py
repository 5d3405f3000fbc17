"""Queries on lines, search, escapes and exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..corpus import LINES_SQL, documents, lines, table
from ..functions import text as T
from ..operators import search as S
from .catalog import query

NORM = "replace(replace(replace(replace(replace(lower(text), chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl')"
BOUND = "regexp_matches({c}, '[\\s[:cntrl:].,;:!?()\\[\\]{{}}\"''\\-/\\\\]')"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(documents(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_index, ((length(n) - length(replace(n, 'the', ''))) // 3)::BIGINT AS hits FROM (SELECT *, {NORM} AS n FROM lines) WHERE contains(n, 'the')")
def find_term_hits(spark, sf_dir):
    return S.find_counts(doc_lines(spark, sf_dir), "The")


def _starts(needle: str, source: str = "n") -> str:
    return f"list_filter(range(greatest(length({source}) - {len(needle)} + 1, 0)), lambda i: substring({source}, (i + 1)::BIGINT, {len(needle)}) = '{needle}')"


@query(f"""WITH {LINES_SQL}, hit AS (SELECT doc_id, page, line_index, n, unnest({_starts('on')}) AS o FROM (SELECT *, {NORM} AS n FROM lines) WHERE contains(n, 'on'))
SELECT doc_id, page, line_index, o::BIGINT AS char_offset, 2::BIGINT AS char_len, strlen(substring(n, 1, o))::BIGINT AS byte_offset, 2::BIGINT AS byte_len, 'on' AS matched_text FROM hit""")
def find_all_offsets(spark, sf_dir):
    return S.find_all(doc_lines(spark, sf_dir), "ON")


@query(f"""WITH {LINES_SQL}, hit AS (SELECT doc_id, page, line_index, n, unnest({_starts('the')}) AS o FROM (SELECT *, {NORM} AS n FROM lines) WHERE contains(n, 'the'))
SELECT doc_id, page, line_index, o::BIGINT AS char_offset, 3::BIGINT AS char_len, strlen(substring(n, 1, o))::BIGINT AS byte_offset, 3::BIGINT AS byte_len, 'the' AS matched_text FROM hit
WHERE (o = 0 OR {BOUND.format(c='substring(n, o, 1)')}) AND (o + 3 = length(n) OR {BOUND.format(c='substring(n, o + 4, 1)')})""")
def find_whole_word(spark, sf_dir):
    return S.find_all(doc_lines(spark, sf_dir), "the", whole_word=True)


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, line_index, o::BIGINT AS char_offset, 4::BIGINT AS char_len, strlen(substring(n, 1, o))::BIGINT AS byte_offset, 4::BIGINT AS byte_len, 'hehe' AS matched_text
FROM (SELECT doc_id, page, line_index, n, unnest({_starts('hehe')}) AS o FROM (SELECT *, {NORM} AS n FROM lines) WHERE contains(n, 'hehe'))""")
def find_overlapping(spark, sf_dir):
    return S.find_all(doc_lines(spark, sf_dir), "hehe", overlapping=True)


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, line_index, o::BIGINT AS char_offset, 3::BIGINT AS char_len, strlen(substring(text, 1, o))::BIGINT AS byte_offset, 3::BIGINT AS byte_len, 'The' AS matched_text
FROM (SELECT doc_id, page, line_index, text, unnest({_starts('The', 'text')}) AS o FROM lines WHERE contains(text, 'The'))""")
def find_case_sensitive(spark, sf_dir):
    return S.find_all(doc_lines(spark, sf_dir), "The", case_sensitive=True)


_ON = f"""WITH {LINES_SQL}, hit AS (SELECT doc_id, page, line_index, unnest({_starts('on')}) AS o FROM (SELECT *, {NORM} AS n FROM lines WHERE page = 0) WHERE contains(n, 'on')) SELECT doc_id, (p).l AS line_index, (p).o::BIGINT AS char_offset FROM """


@query(_ON + "(SELECT doc_id, min({'l': line_index, 'o': o}) AS p FROM hit WHERE (line_index, o) >= (1, 5) GROUP BY doc_id)")
def find_first_from_cursor(spark, sf_dir):
    return S.first_from(S.find_all(doc_lines(spark, sf_dir), "on"), 0, 1, 5)


@query(_ON + "(SELECT doc_id, max({'l': line_index, 'o': o}) AS p FROM hit WHERE (line_index, o + 2) <= (3, 40) GROUP BY doc_id)")
def find_last_before_cursor(spark, sf_dir):
    return S.last_before(S.find_all(doc_lines(spark, sf_dir), "on"), 0, 3, 40)


_PAGES = f"""WITH {LINES_SQL}, per AS (SELECT doc_id, page, sum((length(n) - length(replace(n, 'tion', ''))) // 4)::BIGINT AS hits,
 bool_and(length(text) = 0 OR (instr(text, chr(65533)) = 0 AND length(regexp_replace(text, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) / length(text) < 0.1)) AS reliable
 FROM (SELECT *, {NORM} AS n FROM lines) GROUP BY doc_id, page HAVING sum((length(n) - length(replace(n, 'tion', ''))) // 4) > 0) """


@query(_PAGES + "SELECT doc_id, page, hits, reliable FROM per")
def find_in_pages(spark, sf_dir):
    return S.page_results(doc_lines(spark, sf_dir), "tion")


@query(_PAGES + "SELECT doc_id, page, hits, reliable FROM per QUALIFY page = min(page) OVER (PARTITION BY doc_id)")
def find_first_window(spark, sf_dir):
    return S.page_results(doc_lines(spark, sf_dir), "tion", first_window=True)


@query(_PAGES + "SELECT doc_id, count(*) AS pages, sum(hits)::BIGINT AS total, bool_or(NOT reliable) AS has_unreliable FROM per GROUP BY doc_id")
def search_totals(spark, sf_dir):
    return S.totals(S.page_results(doc_lines(spark, sf_dir), "tion"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, line_index, o::BIGINT AS char_offset FROM (SELECT doc_id, page, line_index, lower(text) AS n, unnest({_starts('he', 'lower(text)')}) AS o FROM lines WHERE contains(lower(text), 'he'))
WHERE NOT regexp_matches(CASE WHEN o = 0 THEN ' ' ELSE substring(n, o, 1) END, '[0-9A-Za-z]') AND NOT regexp_matches(substring(n, o + 3, 1), '[0-9A-Za-z]')""")
def redaction_term_regions(spark, sf_dir):
    return S.redaction_regions(doc_lines(spark, sf_dir), "he", whole_word=True)


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, line_index, o::BIGINT AS char_offset, round(72 + 468.0 * o / length(n), 4) AS x, round(greatest(468.0 * 4 / length(n), 4.68), 4) AS width
FROM (SELECT doc_id, page, line_index, n, unnest({_starts('tion')}) AS o FROM (SELECT *, {NORM} AS n FROM lines) WHERE contains(n, 'tion'))""")
def selection_boxes(spark, sf_dir):
    rows, term = S.haystack(doc_lines(spark, sf_dir), "tion", False)
    rows = S.with_hits(rows, term)
    x, width = S.selection_box(F.col("norm"), F.col("char_offset"), F.lit(4), F.lit(72.0), F.lit(468.0))
    return rows.select("doc_id", "page", "line_index", F.col("char_offset").cast("long"), F.round(x, 4).alias("x"), F.round(width, 4).alias("width"))


@query("SELECT doc_id, length(text) = 0 OR (instr(text, chr(65533)) = 0 AND length(regexp_replace(text, '[^\\x{E000}-\\x{F8FF}]', '', 'g')) / length(text) < 0.1) AS reliable, length(trim(text)) > 0 AS has_text FROM documents")
def text_reliability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_reliable(F.col("text")).alias("reliable"), (F.length(F.trim("text")) > 0).alias("has_text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, bool_or(trim(text) <> '') AS has_text, count(*) AS lines FROM lines GROUP BY doc_id, page")
def pages_with_text(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.bool_or(F.trim("text") != "").alias("has_text"), F.count(F.lit(1)).alias("lines"))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""WITH {LINES_SQL} SELECT doc_id, page, CASE WHEN count(*) FILTER (WHERE trim(text) <> '') = 0 THEN '<p>No text on this page.</p>'
ELSE string_agg('<p>' || {_ESC} || '</p>', chr(10) ORDER BY line_index) FILTER (WHERE trim(text) <> '') END AS html FROM lines GROUP BY doc_id, page""")
def export_html(spark, sf_dir):
    from ..sources.writers import page_html

    return page_html(doc_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY line_index)) AS text_md5 FROM lines GROUP BY doc_id, page")
def export_plain_text(spark, sf_dir):
    from ..sources.writers import page_text

    return page_text(doc_lines(spark, sf_dir)).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query("""SELECT conv_id, '{"conv":' || conv_id || ',"turns":' || count(*) || ',"first":"' || arg_min(role, turn) || '"}' AS json FROM conversations GROUP BY conv_id""")
def export_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first"))
    return c.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns", "first")).alias("json"))


@query("""SELECT conv_id, string_agg('<text page="0" rect="0.0,' || turn || '.0,100.0,' || (turn + 12) || '.0" title="' || role || '"/>', '' ORDER BY turn) AS xfdf FROM conversations GROUP BY conv_id""")
def export_xfdf(spark, sf_dir):
    from ..sources.xfdf import annotation_element

    c = table(spark, sf_dir, "conversations")
    el = annotation_element("text", F.lit(0), [F.lit(0.0), F.col("turn").cast("double"), F.lit(100.0), F.col("turn").cast("double") + 12], F.col("role"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", el.alias("e")))), lambda x: x["e"]), "").alias("xfdf"))


@query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_len, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def html_escapes(spark, sf_dir):
    e = T.html_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(e).cast("long").alias("escaped_len"), F.md5(e).alias("escaped_md5"))


@query("SELECT page_id, md5(html) AS back_md5 FROM pages")
def xml_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_unescape(T.xml_escape(F.col("html")))).alias("back_md5"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS literal_md5 FROM documents")
def pdf_string_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.pdf_escape(F.col("text"))).alias("literal_md5"))


@query("SELECT doc_id, base64(encode(text)) AS b64, lower(hex(encode(text))) AS hexed, lower(hex(encode(source))) || ':' || (doc_id % 7) AS record_key FROM documents")
def base64_hex_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")).alias("b64"), F.lower(F.hex(F.col("text").cast("binary"))).alias("hexed"), T.composite_key(F.lower(F.hex(F.col("source").cast("binary"))), F.col("doc_id") % 7).alias("record_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey > 999999 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 6, '0') END AS bates, regexp_replace(printf('%.4f', o_totalprice / 7), '\\.?0+$', '') AS pdf_number FROM orders")
def number_formats(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.padded(F.col("o_orderkey"), 6).alias("bates"), T.short_number(F.col("o_totalprice") / 7).alias("pdf_number"))


@query("SELECT page_id, CASE WHEN t = '' THEN 'attachment' ELSE t END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/\\\\]*$', 0), '[\\x00-\\x1f<>:\"|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS t FROM pages)")
def attachment_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("name"))


_NAMED = "SELECT page_id, lower(CASE WHEN t = '' THEN 'attachment' ELSE t END) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/\\\\]*$', 0), '[\\x00-\\x1f<>:\"|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS t FROM pages)"


@query(f"SELECT page_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS unique_name FROM (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM ({_NAMED}))")
def attachment_unique_names(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower(T.safe_file_name(F.col("url"))).alias("name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("page_id"))
    return rows.withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "n")).alias("unique_name"))


_INDEX = f"""WITH {LINES_SQL}, pg AS (SELECT doc_id * 1000 + page AS key, string_agg(text, ' ' ORDER BY line_index) AS text FROM lines GROUP BY ALL),
w AS (SELECT key, unnest(string_split_regex({NORM}, '[^a-z0-9]+')) AS term FROM pg), p AS (SELECT key, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY key, term)"""


def index_pages(spark, sf_dir):
    """key of a page, text: a row a line, since no term crosses a line end."""
    return doc_lines(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("page")).alias("key"), "text")


@query(_INDEX + """, l AS (SELECT key, sum(tf) AS dl FROM p GROUP BY key), s AS (SELECT (SELECT count(*) FROM pg) AS n, (SELECT sum(dl) FROM l) AS total), d AS (SELECT term, count(*) AS df FROM p WHERE term IN ('idiot', 'license', 'version') GROUP BY term)
SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / total))) * 1000)::BIGINT AS score_milli FROM p JOIN d USING (term) JOIN l USING (key), s GROUP BY key ORDER BY score_milli DESC, key LIMIT 20""")
def index_search(spark, sf_dir):
    return S.rank(index_pages(spark, sf_dir), "license VERSION idiot", 20)


@query(_INDEX + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def index_terms(spark, sf_dir):
    return S.postings(index_pages(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("""SELECT source, page, revision, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY revision DESC, seq DESC) AS nth FROM (SELECT l_suppkey AS source, l_linenumber AS page, l_orderkey AS revision, l_partkey AS seq FROM lineitem)) WHERE nth = 1""")
def index_upsert(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("revision"), F.col("l_partkey").alias("seq"))
    return S.upserted(li.where("revision % 2 = 0"), li.where("revision % 2 = 1"))


@query("SELECT l_suppkey AS source, count(*) AS pages FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_suppkey")
def index_delete(spark, sf_dir):
    index = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"))
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("source"))
    return S.removed(index, gone).groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
