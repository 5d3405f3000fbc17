"""Queries on reading order, glyph lines, stamps, histories and diagnostics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..corpus import table
from ..operators import drawing as G
from ..operators import jobs as J
from ..operators import reading as R
from .catalog import query


def refs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq")).agg(F.max("l_partkey").alias("mcid"), F.max("l_returnflag").alias("element"))
    return li.withColumn("page", F.lit(0))


def content(spark, sf_dir):
    """Every part that isn't a multiple of 4 was drawn, once per document it is in."""
    return refs(spark, sf_dir).where("mcid % 4 <> 0").select("doc", "page", "mcid", F.concat(F.col("mcid").cast("string"), F.lit(";")).alias("text")).distinct()


_REFS = "r AS (SELECT l_orderkey AS doc, l_linenumber AS seq, max(l_partkey) AS mcid, max(l_returnflag) AS element FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN mcid % 4 <> 0 THEN mcid || ';' END AS text FROM r)"


@query(f"WITH {_REFS} SELECT doc, count(*) AS refs, count(*) FILTER (WHERE text IS NULL) AS missing FROM o GROUP BY doc")
def reading_order_join(spark, sf_dir):
    return R.missing(R.ordered_content(refs(spark, sf_dir), content(spark, sf_dir)))


@query(f"WITH {_REFS}, c AS (SELECT *, CASE WHEN lag(element) OVER (PARTITION BY doc ORDER BY seq) IS NOT DISTINCT FROM element THEN 0 ELSE 1 END AS change FROM o), b AS (SELECT *, sum(change) OVER (PARTITION BY doc ORDER BY seq) AS block FROM c) SELECT doc, block::INT AS block, element, count(*) AS pieces, string_agg(coalesce(text, ''), '' ORDER BY seq) AS text FROM b GROUP BY doc, block, element")
def reading_blocks(spark, sf_dir):
    return R.blocks(R.ordered_content(refs(spark, sf_dir), content(spark, sf_dir)))


@query("""WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, left(event_type, 1) AS c, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS y FROM events),
 s AS (SELECT user_id, 1::BIGINT AS n, y AS anchor, 1 AS line, c FROM g WHERE n = 1 UNION ALL
 SELECT s.user_id, g.n, CASE WHEN g.y IS NULL OR abs(g.y - s.anchor) <= 4 THEN s.anchor ELSE g.y END, CASE WHEN g.y IS NULL OR abs(g.y - s.anchor) <= 4 THEN s.line ELSE s.line + 1 END, g.c FROM s JOIN g ON g.user_id = s.user_id AND g.n = s.n + 1)
 SELECT user_id, count(DISTINCT line) AS lines, md5(string_agg(t, '|' ORDER BY line)) AS text_md5 FROM (SELECT user_id, line, string_agg(c, '' ORDER BY n) AS t FROM s GROUP BY user_id, line) GROUP BY user_id""")
def glyph_lines(spark, sf_dir):
    y = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    first = F.struct("event_id", F.left("event_type", F.lit(1)).alias("char"), y.alias("y"))
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(first)).alias("g"))
    rows = held.select("user_id", R.glyph_lines(F.col("g")).alias("l"))
    return rows.select("user_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "|")).alias("text_md5"))


@query("SELECT l_orderkey AS line, min(l_quantity) AS x, min(l_discount) AS y, max(l_quantity + l_linenumber) - min(l_quantity) AS width, round(max(l_discount + l_tax) - min(l_discount), 6) AS height FROM lineitem GROUP BY l_orderkey")
def line_boxes(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_linenumber").cast("double").alias("width"), F.col("l_tax").alias("height"))
    return R.boxes(g).withColumn("height", F.round("height", 6))


@query("SELECT p_partkey, printf('q BT /F1 12.0 Tf 1.0000 0.0000 -0.0000 1.0000 %.2f 744.00 Tm (%s) Tj ET Q', 36 + 0.5 * (540 - length(p_name) * 6.0), p_name) AS stream FROM part")
def stamp_streams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.stamp(F.col("p_name"), "top-center", 612.0, 792.0).alias("stream"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Text' END AS subtype FROM part")
def annotation_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("highlight", "note", "unknown"))), F.col("p_size") % 3 + 1)
    return G.kinds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"))).select("id", "subtype")


@query("SELECT l_orderkey AS doc, array_to_string(list_concat(list_sort(list(l_partkey)), [l_orderkey]), ' ') AS refs FROM lineitem GROUP BY l_orderkey")
def page_references(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("page"), F.array("o_orderkey").alias("refs"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), F.col("l_partkey").alias("ref"))
    return G.with_references(pages, new).where("size(refs) > 1").select("doc", F.array_join(F.transform("refs", lambda x: x.cast("string")), " ").alias("refs"))


@query("WITH RECURSIVE d AS (SELECT p_partkey AS job, p_partkey // 3 AS needs FROM part WHERE p_partkey // 3 <> p_partkey), b AS (SELECT p_partkey AS job FROM part WHERE p_partkey IN (2, 5) UNION SELECT d.job FROM d JOIN b ON d.needs = b.job) SELECT job FROM b WHERE job NOT IN (2, 5)")
def blocked_jobs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job"))
    deps = p.select("job", F.floor(F.col("job") / 3).alias("needs")).where("needs <> job")
    return J.blocked(deps, p.where("job IN (2, 5)"))


@query("SELECT e.event_id, coalesce(s.action, 'none') AS action FROM events e LEFT JOIN (VALUES ('click', 'open'), ('view', 'zoom')) s(event_type, action) USING (event_type)")
def shortcut_lookup(spark, sf_dir):
    keys = spark.createDataFrame([("click", "open"), ("view", "zoom")], "event_type string, action string")
    return table(spark, sf_dir, "events").join(F.broadcast(keys), "event_type", "left").select("event_id", F.coalesce("action", F.lit("none")).alias("action"))


@query("SELECT event_id, '[redacted]' AS props FROM events")
def log_redaction(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.lit("[redacted]").alias("props"))


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"chars\":' || n_chars || ',\"lines\":' || len(string_split(text, chr(10))) || ',\"labelled\":' || (doc_id IN (SELECT doc_id FROM labels))::VARCHAR || '}' AS report FROM documents")
def diagnostics_report(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    d = table(spark, sf_dir, "documents").join(lab, "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct("doc_id", F.col("n_chars").alias("chars"), F.size(F.split("text", "\n")).alias("lines"), F.coalesce("l", F.lit(False)).alias("labelled"))).alias("report"))
