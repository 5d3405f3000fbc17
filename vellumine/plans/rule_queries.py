"""Queries on forms, layout, compliance, jobs, recognised text and plugins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..corpus import LINES_SQL, PAGE_LINES, documents, lines, split_lines, table
from ..operators import compliance as C
from ..operators import forms as M
from ..operators import jobs as J
from ..operators import layout as L
from ..operators import ocr as O
from .catalog import query


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'radio' ELSE 'checkbox' END WHEN 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'combo' ELSE 'list' END WHEN 2 THEN 'signature' ELSE 'text' END AS kind FROM part")
def field_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Btn", "Ch", "Sig", "Tx"))), F.col("p_size") % 4 + 1)
    flags = F.when(F.col("p_partkey") % 3 == 0, 0x8000).otherwise(0) + F.when(F.col("p_partkey") % 5 == 0, 0x20000).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", M.kind(kind, flags).alias("kind"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END WHEN 1 THEN p_brand || ', ' || p_type ELSE p_name END AS shown, lower(p_brand) NOT IN ('', 'off', 'no', 'false', '0') AS is_on FROM part")
def field_display(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, ("bool", "multi", "text"))), F.col("p_size") % 3 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", M.display(tag, F.col("p_name"), F.col("p_size") > 25, F.array("p_brand", "p_type")).alias("shown"), M.is_on(F.col("p_brand")).alias("is_on"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 AND n = 0 THEN 'required' END, CASE WHEN n > 22 THEN 'too long' END, CASE WHEN n > 0 AND n < 12 THEN 'too short' END], lambda x: x IS NOT NULL), ';') AS broken FROM (SELECT *, strlen(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END) AS n FROM part)")
def field_validation(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(M.violations(value, F.col("p_size") % 2 == 0, F.lit(12), F.lit(22)), ";").alias("broken"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice * (1 - l_discount) + -l_tax * 2) / nullif(l_quantity - 10, 0) AS result FROM lineitem")
def expression_columns(spark, sf_dir):
    e = M.as_column('(l_extendedprice * (1 - getField("l_discount").value) + -l_tax * 2) / (l_quantity - 10)')
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.alias("result"))


@query("SELECT l_orderkey AS form, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(ln(product(l_quantity)), 6) AS log_product FROM lineitem GROUP BY l_orderkey")
def form_aggregates(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("form")).agg(F.round(F.sum(q), 4).alias("total"), F.round(F.avg(q), 4).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.log(F.product(q)), 6).alias("log_product"))


@query("""SELECT p_partkey AS form, p_size + p_size * 2 AS total, 'error: division by zero' AS ratio FROM part""")
def form_calculation_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = p.select(
        F.col("p_partkey").alias("form"),
        F.map_from_arrays(F.array(*map(F.lit, ("a", "b", "zero", "total", "ratio"))), F.array(F.col("p_size").cast("string"), F.lit("0"), F.lit("0"), F.lit(""), F.lit(""))).alias("fields"),
        F.create_map(F.lit("b"), F.lit("a * 2"), F.lit("total"), F.lit('AFSimple_Calculate("SUM", new Array("a", "b"))'), F.lit("ratio"), F.lit("total / zero")).alias("scripts"),
        F.array(F.lit("b"), F.lit("total"), F.lit("ratio")).alias("calc_order"), F.lit(True).alias("enabled"))
    done = M.run_calculations(forms)
    return done.select("form", F.element_at("fields", "total").cast("int").alias("total"), F.regexp_replace(F.element_at("log", -1), "^ratio: ", "").alias("ratio"))


@query("""SELECT p_partkey AS form, CASE p_partkey % 8 WHEN 0 THEN (p_size + 1)::VARCHAR WHEN 1 THEN (p_size * 2)::VARCHAR WHEN 2 THEN (p_size + p_partkey)::VARCHAR WHEN 3 THEN least(p_size, p_partkey)::VARCHAR
 WHEN 4 THEN (p_size::BIGINT * p_partkey)::VARCHAR ELSE '' END AS result, CASE p_partkey % 8 WHEN 5 THEN 'error: unsupported: eval(' WHEN 6 THEN 'error: unsupported: function' WHEN 7 THEN 'error: no field nobody' ELSE 'updated' END AS outcome FROM part""")
def form_scripts(spark, sf_dir):
    """A script by row: field names that hold words of code, operations in any case, refused and failing ones."""
    scripts = (
        'this.getField("evaluation").value + 1', 'getField("requirements").value * 2', 'AFSimple_Calculate("sum", ["evaluation", "important"])', "afsimple_calculate('Min', new Array('evaluation', 'important'));",
        'AFSimple_Calculate("PRD", new Array("evaluation", "important"))', 'eval("1")', "function f() { return 1 }", 'getField("nobody").value',
    )
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    forms = p.select(
        F.col("p_partkey").alias("form"), F.map_from_arrays(F.array(*map(F.lit, ("evaluation", "requirements", "important", "result"))), F.array(size, size, key, F.lit(""))).alias("fields"),
        F.create_map(F.lit("result"), F.element_at(F.array(*map(F.lit, scripts)), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("scripts"), F.array(F.lit("result")).alias("calc_order"), F.lit(True).alias("enabled"))
    return M.run_calculations(forms).select("form", F.element_at("fields", "result").alias("result"), F.regexp_replace(F.element_at("log", -1), "^result: ", "").alias("outcome"))


@query("SELECT p_brand AS form, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size, p_partkey) AS tab_order FROM part GROUP BY p_brand")
def tab_order(spark, sf_dir):
    held = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("form")).agg(F.array_join(F.transform(held, lambda x: x["p_partkey"].cast("string")), ",").alias("tab_order"))


@query("SELECT p_brand AS form, count(*) AS fields, count(*) FILTER (WHERE p_size > 25) AS on_count FROM part GROUP BY p_brand")
def form_export_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("form")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, "Yes").otherwise("Off")))).alias("m"))
    return p.select("form", F.size("m").cast("long").alias("fields"), F.size(F.map_filter("m", lambda k, v: v == "Yes")).cast("long").alias("on_count"))


@query("SELECT p_partkey, p_name AS content FROM part WHERE p_size % 4 NOT IN (0, 2) AND p_name <> ''")
def flatten_form(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Btn", "Ch", "Sig", "Tx"))), F.col("p_size") % 4 + 1)
    p = table(spark, sf_dir, "part").withColumn("kind", M.kind(kind, F.lit(0)))
    return p.where("kind NOT IN ('checkbox', 'radio', 'signature') AND p_name <> ''").select("p_partkey", F.col("p_name").alias("content"))


@query("""WITH RECURSIVE f AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
 t AS (SELECT node, name AS full_name FROM f WHERE parent IS NULL UNION ALL SELECT f.node, t.full_name || '.' || f.name FROM t JOIN f ON f.parent = t.node) SELECT node, full_name FROM t WHERE node NOT IN (SELECT parent FROM f WHERE parent IS NOT NULL)""")
def field_full_names(spark, sf_dir):
    r = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS node", "CAST(NULL AS string) AS parent", "r_name AS name")
    n = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS node", "concat('r', n_regionkey) AS parent", "n_name AS name")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS node", "concat('n', s_nationkey) AS parent", "s_name AS name")
    return M.full_names(r.unionByName(n).unionByName(s))


# Layout


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("page"), (F.col("o_orderkey") % 7 * 100 + 300).cast("double").alias("height"))
    return o


_LAID = "laid AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, (o_orderkey % 7 * 100 + 300)::DOUBLE AS height FROM orders), placed AS (SELECT *, coalesce(sum(height + 12) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM laid)"


@query(f"WITH {_LAID} SELECT doc, page::INT AS page, height, y FROM placed")
def page_offsets(spark, sf_dir):
    return L.page_offsets(laid_out(spark, sf_dir), 12.0)


@query(f"WITH {_LAID}, s AS (SELECT doc, page // 2 AS spread, max(height) AS h FROM laid GROUP BY ALL), q AS (SELECT *, coalesce(sum(h + 12) OVER (PARTITION BY doc ORDER BY spread ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM s) SELECT l.doc, l.page::INT AS page, l.height, q.y FROM laid l JOIN q ON q.doc = l.doc AND q.spread = l.page // 2")
def spread_offsets(spark, sf_dir):
    return L.spread_offsets(laid_out(spark, sf_dir), 12.0).select("doc", "page", "height", "y")


@query(f"WITH {_LAID} SELECT doc, arg_min(page, (abs(y + height / 2 - 1500), page))::INT AS page FROM placed GROUP BY doc")
def current_page(spark, sf_dir):
    return L.current_page(L.page_offsets(laid_out(spark, sf_dir), 12.0), 1500.0)


@query(f"WITH {_LAID} SELECT doc, page::INT AS page, trunc(greatest(y, 900) - y)::BIGINT AS from_y, trunc(least(y + height, 1700) - greatest(y, 900))::BIGINT AS seen FROM placed WHERE y < 1700 AND y + height > 900")
def visible_regions(spark, sf_dir):
    return L.visible(L.page_offsets(laid_out(spark, sf_dir), 12.0), 900.0, 800.0)


@query("SELECT p_partkey, arg_min(s, (abs(p_size / 10.0 - s), s))::DOUBLE AS step FROM part, (SELECT unnest([0.25, 0.33, 0.5, 0.67, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0])::DOUBLE AS s) GROUP BY p_partkey, p_size")
def scale_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.nearest_scale(F.col("p_size") / 10.0).alias("step"))


@query("""SELECT id, col, "row", (least(x + w, (col + 1) * 256) - greatest(x, col * 256))::BIGINT AS w, (least(y + h, ("row" + 1) * 256) - greatest(y, "row" * 256))::BIGINT AS h FROM (SELECT *, unnest(range(y // 256, (y + h - 1) // 256 + 1)) AS "row" FROM (SELECT *, unnest(range(x // 256, (x + w - 1) // 256 + 1)) AS col FROM (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS x, p_partkey * 53 % 1000 AS y, p_size * 20 AS w, p_size * 11 AS h FROM part)))""")
def tile_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_partkey") * 53 % 1000).alias("y"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 11).alias("height"))
    return L.tiles(p)


@query("SELECT event_id, round(1 + least(abs(value) / 256 / 1.33, 1) * 7)::INT AS margin FROM events")
def prefetch_margin(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.prefetch_margin(F.col("value"), 256.0, 1, 8).alias("margin"))


@query("SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda v, x: 0.3::DOUBLE * x + 0.7::DOUBLE * v), 6) AS velocity FROM events GROUP BY user_id")
def ema_velocity(spark, sf_dir):
    held = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(held.alias("h")).select("user_id", F.round(L.smoothed(F.transform("h", lambda x: x["value"])), 6).alias("velocity"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 * 90 IN (90, 270) THEN 792.0 ELSE 612.0 END::DOUBLE AS width, CASE WHEN p_size % 4 * 90 IN (90, 270) THEN 612.0 ELSE 792.0 END::DOUBLE AS height, round(greatest(0.1, least(6.0, least(p_retailprice / 612, 900 / 792.0))), 6) AS zoom FROM part")
def rotation_and_fit(spark, sf_dir):
    w, h = L.effective_size(F.lit(612.0), F.lit(792.0), F.col("p_size") % 4 * 90)
    zoom = F.greatest(F.lit(0.1), F.least(F.lit(6.0), F.least(F.col("p_retailprice") / 612, F.lit(900 / 792.0))))
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), F.round(zoom, 6).alias("zoom"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_suppkey)::DOUBLE AS x, abs(l_suppkey - l_quantity)::DOUBLE AS width, greatest(abs(l_tax - l_discount), 1)::DOUBLE AS height FROM lineitem")
def rect_normalization(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = L.normalized(F.col("l_quantity"), F.col("l_discount"), F.col("l_suppkey").cast("double"), F.col("l_tax"))
    return li.withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", F.col("r.x").alias("x"), F.col("r.width").alias("width"), F.greatest(F.col("r.height"), F.lit(1.0)).alias("height"))


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("page"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 600).cast("double").alias("x"), (F.col("p_partkey") * 53 % 700).cast("double").alias("y"), F.col("p_size").cast("double").alias("width"), F.lit(10.0).alias("height"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("page"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 91 % 600).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 700).cast("double").alias("y"), F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))
    return p, s


_BOXES = "WITH a AS (SELECT p_partkey % 5 AS page, p_partkey AS id, p_partkey * 37 % 600 AS x, p_partkey * 53 % 700 AS y, p_size AS w, 10 AS h FROM part), r AS (SELECT s_suppkey % 5 AS page, s_suppkey * 91 % 600 AS x, s_suppkey * 17 % 700 AS y, 60 AS w, 40 AS h FROM supplier) SELECT id, page FROM a WHERE {no} EXISTS (SELECT 1 FROM r WHERE r.page = a.page AND a.x < r.x + r.w AND r.x < a.x + a.w AND a.y < r.y + r.h AND r.y < a.y + a.h)"


@query(_BOXES.format(no=""))
def annotations_in_region(spark, sf_dir):
    return L.overlap_join(*boxes(spark, sf_dir), "semi").select("id", "page")


@query(_BOXES.format(no="NOT"))
def annotations_kept(spark, sf_dir):
    return L.overlap_join(*boxes(spark, sf_dir), "anti").select("id", "page")


@query("SELECT p_partkey AS request, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS priority, row_number() OVER (ORDER BY CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END, p_partkey) AS place FROM part")
def tile_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 25, 1).when(F.col("p_size") <= 40, 2).otherwise(3).alias("priority"))
    return L.queue_places(p, "priority", "request")


# Compliance


_RANGES = "[0, p_partkey % 50, p_partkey % 50 + p_size - 25, 40]"


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 50
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(F.lit(0).cast("long"), n, n + F.col("p_size") - 25, F.lit(40).cast("long")).alias("ranges"))


_WELL = "(p_partkey % 50 > 0 AND p_partkey % 50 + p_size - 25 >= p_partkey % 50 AND p_partkey % 50 + p_size - 25 + 40 <= 100)"


@query(f"SELECT p_partkey, {_WELL} AS well_formed FROM part")
def byte_range_validity(spark, sf_dir):
    return signed(spark, sf_dir).select("p_partkey", C.ranges_well_formed(F.col("ranges"), F.lit(100)).alias("well_formed"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'indeterminate' WHEN NOT {_WELL} THEN 'invalid' WHEN p_partkey % 7 = 0 THEN 'invalid' WHEN p_partkey % 13 = 0 THEN 'invalid' WHEN p_partkey % 3 = 0 THEN 'indeterminate' ELSE 'valid' END AS verdict FROM part")
def signature_verdict(spark, sf_dir):
    k = F.col("p_partkey")
    return signed(spark, sf_dir).select(k, C.verdict(k % 11 != 0, F.col("ranges"), F.lit(100), k % 7 == 0, k % 13 == 0, k % 3 != 0).alias("verdict"))


@query("SELECT doc_id, sha256((CASE WHEN octet_length(b) >= 10 THEN b[1:10] ELSE ''::BLOB END) || (CASE WHEN octet_length(b) >= 25 THEN b[21:25] ELSE ''::BLOB END)) AS digest FROM (SELECT doc_id, encode(text) AS b FROM documents)")
def byte_range_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ranges = F.array(*[F.lit(x).cast("long") for x in (0, 10, 20, 5, 10**9, 5)])
    return d.select("doc_id", C.range_digest(F.col("text").cast("binary"), ranges).alias("digest"))


@query("SELECT page_id, contains(html, '<script') AS has_script, contains(html, '<form') AS has_form, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs, false AS is_encrypted FROM pages")
def byte_patterns(spark, sf_dir):
    b = F.col("html").cast("binary")
    has = lambda s: F.contains(b, F.lit(s.encode()))
    return table(spark, sf_dir, "pages").select("page_id", has("<script").alias("has_script"), has("<form").alias("has_form"), F.regexp_count(F.decode(b, "ISO-8859-1"), F.lit("<p>")).cast("long").alias("paragraphs"), has("/Encrypt").alias("is_encrypted"))


@query("SELECT page_id, 5 - 3 AS problems, false AS conformance FROM pages")
def archival_check(spark, sf_dir):
    content = F.concat(F.lit(b"/Type /Font "), F.col("html").cast("binary"), F.lit(b" /OutputIntents /FontFile2 /Encrypt"))
    p = table(spark, sf_dir, "pages").withColumn("p", C.archival(content))
    return p.select("page_id", F.size("p").alias("problems"), C.conformance(F.col("p")).alias("conformance"))


@query("SELECT p_partkey, '<< /Author () /Title <> /Pages ' || p_size || ' >>' AS info FROM part")
def metadata_scrub(spark, sf_dir):
    info = F.concat(F.lit("<< /Author ("), F.replace(F.col("p_name"), F.lit(")"), F.lit("\\)")), F.lit(") /Title <"), F.hex(F.col("p_brand").cast("binary")), F.lit("> /Pages "), F.col("p_size").cast("string"), F.lit(" >>"))
    return table(spark, sf_dir, "part").select("p_partkey", C.scrubbed(info).alias("info"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_index, regexp_replace(text, 'tion', '████', 'gi') AS text FROM lines WHERE contains(lower(text), 'tion')")
def redact_lines(spark, sf_dir):
    li = lines(documents(spark, sf_dir))
    return C.redact(li.where(F.contains(F.lower("text"), F.lit("tion"))), "tion")


@query(f"""WITH {LINES_SQL}, docs AS (SELECT d.doc_id, unnest(range(greatest(1, coalesce(n, 1)))) AS page FROM documents d LEFT JOIN (SELECT doc_id, max(page) + 1 AS n FROM lines GROUP BY doc_id) USING (doc_id)),
 items AS (SELECT doc_id, page, 1 AS item, 'text' AS kind, 'tion' AS sample FROM docs UNION ALL SELECT doc_id, page, 2, 'text', 'idiot' FROM docs UNION ALL SELECT doc_id, page, 3, 'image', '' FROM docs WHERE doc_id % 3 = 0),
 there AS (SELECT doc_id, page, bool_or(contains(lower(text), 'idiot')) AS found FROM lines GROUP BY doc_id, page),
 j AS (SELECT i.*, CASE WHEN kind <> 'text' THEN 'x' WHEN t.doc_id IS NULL THEN 'm' WHEN i.sample <> 'tion' AND t.found THEN 't' END AS risk FROM items i LEFT JOIN there t USING (doc_id, page))
 SELECT doc_id, count(*) AS regions, count(*) FILTER (WHERE risk IS NULL) AS confirmed, count(risk) AS risks, count(risk) = 0 AS passed FROM j GROUP BY doc_id""")
def redaction_verification(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    li = C.redact(lines(docs), "tion")
    item = lambda i, kind, sample, d: d.select("doc_id", "page", F.lit(i).alias("item"), F.lit(kind).alias("kind"), F.lit(sample).alias("sample"))
    # Removals are registered for every page; a document without lines has its first page.
    count = F.coalesce(F.ceil(F.size(split_lines(F.col("text"))) / PAGE_LINES), F.lit(0)).cast("int")
    docs = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("page"))
    items = item(1, "text", "tion", docs).unionByName(item(2, "text", "idiot", docs)).unionByName(item(3, "image", "", docs.where("doc_id % 3 = 0")))
    return C.verify_redaction(li, items)


@query("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'not examined' ELSE l.quality::VARCHAR END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def redaction_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", C.examined(F.col("quality")).alias("quality"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 40 WHEN 1 THEN 25 WHEN 2 THEN 5 ELSE 20 END AS percent, floor(p_partkey * 1000 * (CASE p_size % 4 WHEN 0 THEN 40 WHEN 1 THEN 25 WHEN 2 THEN 5 ELSE 20 END) / 100)::BIGINT AS saved FROM part")
def optimization_estimate(spark, sf_dir):
    profile = spark.createDataFrame([(0, 40), (1, 25), (2, 5), (3, 20)], "profile int, percent int")
    p = table(spark, sf_dir, "part").join(F.broadcast(profile), F.col("p_size") % 4 == F.col("profile"))
    return p.select("p_partkey", "percent", F.floor(F.col("p_partkey") * 1000 * F.col("percent") / 100).alias("saved"))


# Jobs


def job_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "part")
    return o.select(F.col("p_partkey").alias("job")), o.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("job"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("needs"))


@query("SELECT p_partkey AS job, 'missing dependency' AS problem FROM part WHERE p_partkey % 4 <> 0 AND p_partkey - p_partkey % 4 NOT IN (SELECT p_partkey FROM part)")
def job_problems(spark, sf_dir):
    return J.problems(*job_table(spark, sf_dir))


@query("WITH RECURSIVE d AS (SELECT p_partkey AS job, p_partkey // 3 AS needs FROM part WHERE p_partkey // 3 <> p_partkey AND p_partkey // 3 IN (SELECT p_partkey FROM part)), l AS (SELECT p_partkey AS job, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT job FROM d) UNION ALL SELECT d.job, l.level + 1 FROM l JOIN d ON d.needs = l.job) SELECT job, max(level)::INT AS level FROM l GROUP BY job")
def job_levels(spark, sf_dir):
    jobs, _ = job_table(spark, sf_dir)
    deps = jobs.select("job", F.floor(F.col("job") / 3).alias("needs")).where("needs <> job").join(jobs.select(F.col("job").alias("needs")), "needs", "left_semi")
    return J.levels(jobs, deps)


_RUN = """WITH RECURSIVE j AS (SELECT p_partkey AS job, p_size % 2 = 0 AS idempotent FROM part), d AS (SELECT p_partkey AS job, p_partkey // 5 AS needs FROM part WHERE p_partkey // 5 <> p_partkey AND p_partkey // 5 IN (SELECT p_partkey FROM part)),
 e AS (SELECT l_partkey AS job, l_orderkey AS ts, l_linenumber AS seq, ['started', 'succeeded', 'succeeded', 'succeeded', 'succeeded', 'succeeded', 'crashed', 'failed', 'cancelled', 'succeeded'][(l_orderkey + l_linenumber) % 10 + 1] AS kind FROM lineitem WHERE l_partkey % 3 > 0),
 t AS (SELECT job, arg_max(kind, ts * 100 + seq) AS last, count(*) FILTER (WHERE kind = 'crashed') AS crashes FROM e GROUP BY job),
 s AS (SELECT j.job, last, CASE WHEN last = 'started' THEN 'running' WHEN last = 'crashed' THEN CASE WHEN idempotent AND crashes = 1 THEN 'pending' ELSE 'failed' END ELSE coalesce(last, 'pending') END AS own FROM j LEFT JOIN t USING (job)),
 b AS (SELECT job FROM s WHERE own IN ('failed', 'cancelled') UNION SELECT d.job FROM d JOIN b ON d.needs = b.job),
 r AS (SELECT s.*, own NOT IN ('succeeded', 'failed', 'cancelled') AND s.job IN (SELECT job FROM b) AS lost, EXISTS (SELECT 1 FROM d JOIN s n ON n.job = d.needs WHERE d.job = s.job AND n.own <> 'succeeded') AS waits FROM s)
 SELECT job, CASE WHEN lost THEN 'failed' WHEN own = 'pending' AND NOT waits THEN 'ready' ELSE own END AS state, CASE WHEN lost THEN 'dependency did not complete' WHEN own = 'failed' THEN CASE WHEN last = 'crashed' THEN 'worker crashed' ELSE 'failed' END END AS reason FROM r"""


@query(_RUN)
def job_run_states(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    jobs = p.select(F.col("p_partkey").alias("job"), (F.col("p_size") % 2 == 0).alias("idempotent"))
    deps = jobs.select("job", F.floor(F.col("job") / 5).alias("needs")).where("needs <> job").join(jobs.select(F.col("job").alias("needs")), "needs", "left_semi")
    kinds = F.array(*map(F.lit, ("started", "succeeded", "succeeded", "succeeded", "succeeded", "succeeded", "crashed", "failed", "cancelled", "succeeded")))
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 3 > 0")
    events = li.select(F.col("l_partkey").alias("job"), F.col("l_orderkey").alias("ts"), F.col("l_linenumber").alias("seq"), F.element_at(kinds, ((F.col("l_orderkey") + F.col("l_linenumber")) % 10 + 1).cast("int")).alias("kind"))
    return J.run_states(jobs, deps, events)


@query("SELECT p_brand AS queue, p_partkey AS job, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def ready_queue(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("queue"), F.col("p_partkey").alias("job"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq"))
    return J.ready_order(p).select("queue", "job", F.col("place").cast("long"))


@query("SELECT user_id AS job, CASE WHEN arg_max(event_type, (ts, event_id)) = 'click' THEN 'pending' ELSE arg_max(event_type, (ts, event_id)) END AS kind, count(*) AS events FROM events GROUP BY user_id")
def job_latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("kind"))
    return J.restored(J.latest_state(e))


@query("""WITH r AS (SELECT user_id AS key, ts, event_id AS seq, event_type IN ('click', 'view') AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, seq) AS island FROM r), c AS (SELECT key, island, count(*) AS run FROM g WHERE failed GROUP BY ALL)
SELECT k.key, coalesce(max(c.run), 0)::BIGINT AS longest, coalesce(max(c.run), 0) >= 3 AS opened FROM (SELECT DISTINCT key FROM r) k LEFT JOIN c ON c.key = k.key GROUP BY k.key""")
def circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view").alias("failed"))
    return J.breaker(e)


@query("SELECT source AS batch, doc_id AS seq, used::BIGINT AS used, used <= 50000 AS accepted FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)")
def staging_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("seq"), "text")
    return J.within_budget(d, 50_000).select("batch", "seq", "used", "accepted")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_custkey % 3 = o_orderkey % 3")
def grant_expiry(spark, sf_dir):
    import datetime

    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"), (F.col("o_custkey") % 3).alias("generation"), (F.col("o_orderkey") % 3).alias("live_generation"))
    return J.valid_grants(g, datetime.datetime(1996, 1, 1)).select("id")


@query("SELECT coalesce(f.p, r.p) AS path, CASE WHEN r.p IS NULL THEN 'new' WHEN f.p IS NULL THEN 'deleted' WHEN f.m <> r.m OR f.l <> r.l THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT 'f/' || doc_id AS p, n_chars % 10 AS m, n_chars AS l FROM documents WHERE doc_id % 5 <> 0) f FULL JOIN (SELECT 'f/' || doc_id AS p, CASE WHEN doc_id % 7 = 0 THEN 99 ELSE n_chars % 10 END AS m, n_chars AS l FROM documents WHERE doc_id % 3 <> 0) r ON f.p = r.p")
def reindex_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") % 10).alias("mtime"), F.col("n_chars").alias("length"))
    return J.file_changes(d.where("doc_id % 5 <> 0"), d.where("doc_id % 3 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, 99).otherwise(F.col("mtime"))))


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE doc_id % 7 = 0) AS reindexed, count(*) FILTER (WHERE doc_id % 7 <> 0) AS skipped, sum(n_chars)::BIGINT AS index_size FROM documents")
def reindex_report(spark, sf_dir):
    k = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(k == 0).alias("reindexed"), F.count_if(k != 0).alias("skipped"), F.sum("n_chars").alias("index_size"))


@query("SELECT 'root' || (doc_id % 4) || '/' || source || '/d' || doc_id AS path, 'root' || (doc_id % 4) || '/' || source AS root FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 4 IN (0, 1)")
def enrolled_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("root"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string")).alias("path"))
    roots = spark.createDataFrame([(f"root{i}/src{j}",) for i in (0, 1) for j in (1, 2)], "root string")
    return J.under_roots(d, roots)


@query("SELECT event_id FROM events WHERE user_id % 5 > 2 OR user_id % 5 = 0")
def generation_invalidation(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("user_id") % 5 > 2) | (F.col("user_id") % 5 == 0)).select("event_id")


@query("SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0) g WHERE g.user_id = e.user_id AND g.event_type = e.event_type)")
def capability_check(spark, sf_dir):
    from ..functions.registry import permitted

    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("plugin"), F.col("event_type").alias("capability"))
    return permitted(e, e.where("event_id % 2 = 0")).select("event_id")


@query("SELECT p_partkey, p_size >= 10 AND p_partkey % 3 <> 0 AS valid FROM part")
def plugin_manifests(spark, sf_dir):
    from ..functions.registry import manifests

    raw = F.to_json(F.struct(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") >= 10, "1.2.3").otherwise("1.2").alias("version"), F.when(F.col("p_partkey") % 3 != 0, "host").otherwise("other").alias("world")))
    return manifests(table(spark, sf_dir, "part").select("p_partkey", raw.alias("json")), "host").select("p_partkey", "valid")


# Recognised text


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", "[ \t\n]+")  # a tab would end the field
    row = F.transform(words, lambda w, i: F.concat_ws("\t", F.lit("5\t1\t1\t1\t1"), (i + 1).cast("string"), (i * 40).cast("string"), F.lit("10\t30\t12"), F.when(F.length(w) < 3, "-1").otherwise((F.length(w) * 7 % 100).cast("string")), w))
    return documents(spark, sf_dir).where("length(text) > 0").select(F.col("doc_id").alias("page"), F.concat(F.lit("header\n"), F.array_join(row, "\n"), F.lit("\nshort\trow")).alias("tsv"))


_OCR = "w AS (SELECT doc_id AS page, unnest(string_split_regex(text, '[ \\t\\n]+')) AS w, unnest(range(1, len(string_split_regex(text, '[ \\t\\n]+')) + 1)) AS n FROM documents WHERE length(text) > 0), k AS (SELECT * FROM w WHERE trim(w) <> '' AND length(w) >= 3)"


@query(f"WITH {_OCR} SELECT page, n::INT AS n, ((n - 1) * 40)::DOUBLE AS x, w AS text, (length(w) * 7 % 100) / 100.0 AS confidence FROM k")
def ocr_words(spark, sf_dir):
    return O.parse_tsv(ocr_pages(spark, sf_dir)).select("page", "n", "x", "text", "confidence")


@query(f"WITH {_OCR} SELECT page, string_agg(w, ' ' ORDER BY n) AS full_text, CASE WHEN page % 10 = 0 THEN 'failed' WHEN avg((length(w) * 7 % 100) / 100.0) < 0.5 THEN 'uncertain' ELSE 'applied' END AS outcome FROM k GROUP BY page")
def ocr_gate(spark, sf_dir):
    t = O.page_text(O.parse_tsv(ocr_pages(spark, sf_dir)))
    return t.select("page", "full_text", O.gate(F.col("page") % 10 != 0, F.col("mean_confidence")).alias("outcome"))


@query(f"WITH {_OCR} SELECT page, n::INT AS n, round((n - 1) * 40 * 612.0 / 2550, 6) AS x, round(12 * 792.0 / 3300, 6) AS height, round(greatest(6.0, least(24.0, 1.2 * 30 / strlen(w))), 6) AS font_size FROM k")
def ocr_text_layer(spark, sf_dir):
    w = O.parse_tsv(ocr_pages(spark, sf_dir))
    box = O.scaled(F.col("x"), F.col("y"), F.col("width"), F.col("height"), (612.0, 792.0), (F.lit(2550.0), F.lit(3300.0)))
    return w.withColumn("b", box).select("page", "n", F.round("b.x", 6).alias("x"), F.round("b.height", 6).alias("height"), F.round(O.font_size(F.col("width"), F.col("text")), 6).alias("font_size"))
