"""Queries on threads, versions, trees, page order and comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..corpus import LINES_SQL, PAGE_LINES, documents, lines, split_lines, table
from ..operators import diff as D
from ..operators import review as R
from ..operators import tree as P
from ..operators import versions as V
from .catalog import query


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.col("role").alias("author"), "text")


@query("SELECT conv_id AS thread, count(*) AS comments, arg_max(role, turn) AS last_author FROM conversations GROUP BY conv_id HAVING bool_or(turn = 0)")
def thread_aggregates(spark, sf_dir):
    return R.thread_facts(comments(spark, sf_dir))


@query("SELECT r.conv_id AS thread, r.turn AS ord, r.role AS author, c.role AS root_author FROM conversations r JOIN conversations c ON r.conv_id = c.conv_id AND c.turn = 0 WHERE r.turn > 0")
def thread_replies(spark, sf_dir):
    return R.replies_with_root(comments(spark, sf_dir)).select("thread", "ord", "author", "root_author")


@query("SELECT conv_id AS thread, turn AS ord, role AS author FROM conversations WHERE lower(role) = 'user' AND turn > 0")
def comment_filter_exact(spark, sf_dir):
    return R.filter_exact(comments(spark, sf_dir), author="USER", is_reply=True).select("thread", "ord", "author")


@query("SELECT c.conv_id AS thread, c.role AS root_author, (SELECT count(*) FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn > 0) AS replies FROM conversations c WHERE c.turn = 0 AND contains(lower(c.role), 'se')")
def thread_filter_substring(spark, sf_dir):
    return R.filter_threads(comments(spark, sf_dir), "SE").select("thread", "root_author", F.size("replies").cast("long").alias("replies"))


@query("""SELECT c.conv_id AS thread, c.role || ': ' || c.text || coalesce((SELECT string_agg(chr(10) || '  ' || r.role || ': ' || r.text, '' ORDER BY r.turn, r.role, r.text) FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn > 0), '') AS summary FROM conversations c WHERE c.turn = 0""")
def comment_summary(spark, sf_dir):
    return R.summary(comments(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE turn = 0) AS threads, count(*) AS comments, count(*) FILTER (WHERE turn > 0) AS replies FROM conversations")
def thread_totals(spark, sf_dir):
    c = comments(spark, sf_dir)
    return c.agg(F.count_if(F.col("ord") == 0).alias("threads"), F.count(F.lit(1)).alias("comments"), F.count_if(F.col("ord") > 0).alias("replies"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obj"), F.col("l_linenumber").alias("revision")).agg(F.max("l_partkey").alias("value"))


@query("SELECT l_orderkey AS obj, max(l_linenumber) AS revision, arg_max(l_partkey, (l_linenumber, l_partkey)) AS value FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey")
def version_as_of(spark, sf_dir):
    return V.as_of(versions(spark, sf_dir), 3)


@query("SELECT l_orderkey AS obj, max(l_linenumber) AS revision, arg_max(l_partkey, (l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY l_orderkey")
def version_latest(spark, sf_dir):
    return V.as_of(versions(spark, sf_dir))


@query("""SELECT o_custkey AS obj, e.event_id, max(o_orderkey) AS value FROM (SELECT event_id, user_id, ts FROM events) e JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) o ON o.o_custkey = e.user_id
 WHERE o_orderdate = (SELECT max(x.o_orderdate) FROM orders x WHERE x.o_custkey = e.user_id AND x.o_orderdate <= e.ts) GROUP BY o_custkey, e.event_id""")
def asof_events_orders(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("obj"), F.col("ts").alias("at"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("obj"), F.col("o_orderdate").alias("revision")).agg(F.max("o_orderkey").alias("value"))
    both = o.select("obj", F.col("revision").alias("at"), F.lit(None).cast("long").alias("event_id"), "value").unionByName(e.withColumn("value", F.lit(None).cast("long")))
    held = F.last("value", ignorenulls=True).over(Window.partitionBy("obj").orderBy("at", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("value", held).where("event_id IS NOT NULL AND value IS NOT NULL").select("obj", "event_id", "value")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.min_by("l_suppkey", "l_orderkey").alias("s"))
    return li.select(F.col("l_partkey").alias("obj"), F.col("l_linenumber").alias("section"), F.when(F.col("s") % 4 == 0, 0).otherwise(F.col("s")).alias("offset"), (F.col("s") % 3 != 0).alias("in_use"))


_SEC = "(SELECT l_partkey AS obj, l_linenumber AS section, CASE WHEN arg_min(l_suppkey, l_orderkey) % 4 = 0 THEN 0 ELSE arg_min(l_suppkey, l_orderkey) END AS off, arg_min(l_suppkey, l_orderkey) % 3 <> 0 AS in_use FROM lineitem GROUP BY l_partkey, l_linenumber)"


@query(f'SELECT obj, min(section) AS section, arg_min(off, section) AS "offset", arg_min(in_use, section) AS in_use FROM {_SEC} WHERE off <> 0 OR in_use GROUP BY obj')
def xref_newest_wins(spark, sf_dir):
    return V.newest_wins(sections(spark, sf_dir))


@query(f'SELECT obj, min(section) AS section, arg_min(off, section) AS "offset", arg_min(in_use, section) AS in_use FROM {_SEC} GROUP BY obj')
def xref_newest_wins_strict(spark, sf_dir):
    return V.newest_wins(sections(spark, sf_dir), strict=True)


@query(f'SELECT obj, coalesce(t.off, s.off) AS "offset", t.off IS NOT NULL AS from_table FROM (SELECT obj, off FROM {_SEC} WHERE section = 1 AND in_use) t FULL JOIN (SELECT obj, off FROM {_SEC} WHERE section = 2 AND in_use) s USING (obj)')
def xref_hybrid_overlay(spark, sf_dir):
    s = sections(spark, sf_dir)
    return V.overlay(s.where("section = 1"), s.where("section = 2"))


@query(f"SELECT obj, change, change <> 'deleted' AS allowed FROM (SELECT obj, CASE WHEN b.off IS NULL THEN 'added' WHEN a.off IS NULL THEN 'deleted' WHEN a.off <> b.off THEN 'modified' END AS change FROM (SELECT obj, off FROM {_SEC} WHERE section = 1) b FULL JOIN (SELECT obj, off FROM {_SEC} WHERE section = 2) a USING (obj)) WHERE change IS NOT NULL")
def docmdp_changes(spark, sf_dir):
    s = sections(spark, sf_dir)
    return V.xref_changes(s.where("section = 1"), s.where("section = 2"))


@query(f"SELECT obj FROM {_SEC} b WHERE section = 1 AND EXISTS (SELECT 1 FROM {_SEC} a WHERE a.section = 2 AND a.obj = b.obj AND a.off <> b.off)")
def offsets_moved(spark, sf_dir):
    s = sections(spark, sf_dir)
    return V.offsets_moved(s.where("section = 1"), s.where("section = 2")).select("obj")


@query("SELECT o_custkey AS doc, o_orderkey AS number, (e - lag(e, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS bytes, objects FROM (SELECT o_custkey, o_orderkey, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 20 AS e, n AS objects FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL))")
def revision_history(spark, sf_dir):
    per = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("number")).agg(F.count(F.lit(1)).alias("objects"))
    end = F.sum("objects").over(Window.partitionBy("doc").orderBy("number")) * 20
    return V.revision_history(per.withColumn("end_offset", end)).select("doc", "number", F.col("bytes").cast("long"), "objects")


@query("SELECT l_suppkey AS doc, min(l_partkey) AS first, count(*) AS length FROM (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g")
def consecutive_runs(spark, sf_dir):
    return V.runs(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("n")), ["doc"], "n")


@query("SELECT l_orderkey AS doc, (sum(l_partkey) + 6 + 20 * (count(*) + 1) + 100)::BIGINT AS estimate FROM lineitem GROUP BY l_orderkey")
def incremental_size(spark, sf_dir):
    return V.incremental_size(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("bytes")))


@query("""WITH RECURSIVE ops AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'record' END AS kind, event_id::VARCHAR AS name FROM events),
 s AS (SELECT user_id, 0::BIGINT AS n, []::VARCHAR[] AS applied, []::VARCHAR[] AS undone FROM ops GROUP BY user_id UNION ALL
 SELECT s.user_id, o.n, CASE WHEN kind = 'record' THEN list_append(applied, name) WHEN kind = 'undo' AND len(applied) > 0 THEN applied[:-2] WHEN kind = 'redo' AND len(undone) > 0 THEN list_append(applied, undone[-1]) ELSE applied END,
 CASE WHEN kind = 'record' THEN [] WHEN kind = 'undo' AND len(applied) > 0 THEN list_append(undone, applied[-1]) WHEN kind = 'redo' AND len(undone) > 0 THEN undone[:-2] ELSE undone END FROM s JOIN ops o ON o.user_id = s.user_id AND o.n = s.n + 1)
 SELECT user_id, array_to_string(arg_max(applied, n), ',') AS applied, array_to_string(arg_max(undone, n), ',') AS undone FROM s GROUP BY user_id""")
def undo_redo_state(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "undo").when(F.col("event_type") == "view", "redo").otherwise("record")
    held = F.array_sort(F.collect_list(F.struct("ts", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("name"))))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(held.alias("ops"))
    return per.withColumn("s", V.undo_state(F.col("ops"))).select("user_id", F.array_join("s.applied", ",").alias("applied"), F.array_join("s.undone", ",").alias("undone"))


@query("SELECT user_id AS cache, event_type AS key, seq, bytes FROM (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY seq DESC) AS used FROM (SELECT user_id, event_type, max(event_id) AS seq, arg_max(event_id % 97, event_id) AS bytes FROM events GROUP BY user_id, event_type)) WHERE used <= 120")
def lru_retained(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("cache"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("bytes"))
    return V.retained(e, 120).select("cache", "key", "seq", "bytes")


@query('SELECT l_orderkey AS "group", (count(*) OVER (PARTITION BY l_orderkey) - 1 - (l_linenumber - 1))::BIGINT AS ord, l_partkey AS obj, l_tax AS old, l_discount AS new FROM lineitem WHERE l_linenumber = l_linenumber')
def undo_commands(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_linenumber") - 1).alias("ord"), F.col("l_partkey").alias("obj"), F.col("l_discount").alias("old"), F.col("l_tax").alias("new"))
    return V.undo_commands(c).withColumn("ord", F.col("ord").cast("long"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and order as a tree; some nodes carry a rotation."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t("region").select(node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") * 90).cast("int").alias("rotation"), F.col("r_name").alias("title"))
    n = t("nation").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, -90).alias("rotation"), F.col("n_name").alias("title"))
    c = t("customer").select(node("c", "c_custkey").alias("node"), node("n", "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, 180).alias("rotation"), F.col("c_name").alias("title"))
    o = t("orders").select(node("o", "o_orderkey").alias("node"), node("c", "o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 7 == 0, 450).alias("rotation"), F.col("o_orderkey").cast("string").alias("title"))
    return r.unionByName(n).unionByName(c).unionByName(o)


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, (r_regionkey * 90)::INT AS rotation, r_name AS title FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN -90 END, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 180 END, c_name FROM customer
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 450 END, o_orderkey::VARCHAR FROM orders),
 up AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT up.node, n.parent, up.distance + 1 FROM up JOIN nodes n ON up.ancestor = n.node WHERE n.parent IS NOT NULL)"""


@query(f"WITH RECURSIVE {_NODES} SELECT u.node, (((arg_min(n.rotation, u.distance) % 360) + 360) % 360)::INT AS rotation FROM up u JOIN nodes n ON n.node = u.ancestor WHERE n.rotation IS NOT NULL GROUP BY u.node")
def inherited_rotation(spark, sf_dir):
    return P.inherited(nodes(spark, sf_dir), "rotation").select("node", F.pmod("rotation", F.lit(360)).cast("int").alias("rotation"))


@query(f"WITH RECURSIVE {_NODES} SELECT u.ancestor AS node, count(*) AS leaves FROM up u WHERE u.node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) GROUP BY u.ancestor")
def tree_leaf_counts(spark, sf_dir):
    return P.leaf_counts(nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES} SELECT ancestor AS node, count(*) AS nodes, max(distance)::INT AS height FROM up GROUP BY ancestor")
def tree_totals(spark, sf_dir):
    return P.subtree_sizes(nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES} SELECT u.node, max(u.distance)::INT AS depth, string_agg(n.title, '/' ORDER BY u.distance DESC) AS path FROM up u JOIN nodes n ON n.node = u.ancestor GROUP BY u.node")
def outline_paths(spark, sf_dir):
    return P.paths(nodes(spark, sf_dir), "title")


@query(f"WITH RECURSIVE {_NODES} SELECT node FROM up WHERE ancestor = 'r1'")
def reachable_from_root(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return P.reachable(n.select(F.col("parent").alias("src"), F.col("node").alias("dst")), n.where("node = 'r1'"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page")).agg(F.max("l_partkey").alias("content"))


_P = "(SELECT l_orderkey AS doc, l_linenumber - 1 AS page, max(l_partkey) AS content FROM lineitem GROUP BY ALL)"
_RN = "(row_number() OVER (PARTITION BY doc ORDER BY {o}) - 1)::INT AS page"


@query(f"SELECT doc, {_RN.format(o='part, page')}, part, content FROM (SELECT o_custkey AS doc, o_orderkey AS part, l_linenumber - 1 AS page, max(l_partkey) AS content FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def merge_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("part"))
    return P.merge(pages(spark, sf_dir).join(o, F.col("doc") == F.col("part")).select(F.col("owner").alias("doc"), "part", "page", "content"))


@query(f"SELECT doc, (page // 3 + 1)::INT AS chunk, (page % 3)::INT AS page, content FROM {_P}")
def split_chunks(spark, sf_dir):
    return P.chunks(pages(spark, sf_dir), 3)


@query(f"SELECT doc, {_RN.format(o='page')}, content FROM {_P} WHERE page BETWEEN 1 AND 3")
def extract_pages(spark, sf_dir):
    return P.extract(pages(spark, sf_dir), 2, 4)


@query(f"SELECT doc, {_RN.format(o='page')}, content FROM (SELECT *, count(*) FILTER (WHERE page NOT IN (0, 2)) OVER (PARTITION BY doc) AS rest FROM {_P}) WHERE rest = 0 OR page NOT IN (0, 2)")
def delete_pages(spark, sf_dir):
    return P.delete(pages(spark, sf_dir), P.page_list("1,3", 7))


@query(f"SELECT doc, {_RN.format(o='page, c')}, content FROM (SELECT *, 1 AS c FROM {_P} UNION ALL SELECT *, 2 FROM {_P} WHERE page IN (1))")
def duplicate_pages(spark, sf_dir):
    return P.duplicate(pages(spark, sf_dir), [1])


@query(f"SELECT doc, {_RN.format(o='place')}, content FROM (SELECT doc, page::DOUBLE AS place, content FROM {_P} UNION ALL SELECT doc, 1.5, NULL FROM {_P} GROUP BY doc HAVING count(*) >= 2)")
def insert_blank_page(spark, sf_dir):
    return P.insert_blank(pages(spark, sf_dir), 2)


@query(f"SELECT doc, {_RN.format(o='CASE WHEN page IN (2, 3) THEN -0.5 ELSE page END, page')}, content FROM {_P}")
def move_pages(spark, sf_dir):
    return P.move(pages(spark, sf_dir), [2, 3], 0)


@query(f"SELECT doc, {_RN.format(o='part, old')}, old, origin FROM (SELECT doc, CASE WHEN page < 1 THEN 0 ELSE 2 END AS part, page AS old, 'base' AS origin FROM {_P} UNION ALL SELECT doc, 1, page, 'other' FROM {_P} WHERE page < 2)")
def insert_range(spark, sf_dir):
    p = pages(spark, sf_dir)
    return P.splice(p, p.where("page < 2"), 2)


@query("SELECT l_orderkey AS doc, l_linenumber - 1 AS page, ((l_partkey % 4 * 90 + 90) % 360)::INT AS rotation, l_quantity <= 30 AS crop_ok FROM lineitem")
def rotate_crop_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page"), F.pmod(F.col("l_partkey") % 4 * 90 + 90, F.lit(360)).cast("int").alias("rotation"), (F.lit(20.0) + F.col("l_quantity") <= 50).alias("crop_ok"))


_KINDS = ("create", "edit", "delete", "status", "edit", "create", "status", "edit", "edit", "status", "create")


@query(f"""WITH c AS (SELECT user_id AS doc, event_id % 7 AS annotation, event_id AS seq, {list(_KINDS)}[event_id * 7 % 11 + 1] AS kind, event_type AS value FROM events),
 m AS (SELECT doc, annotation, max(seq) FILTER (WHERE kind = 'create') AS made, max(seq) FILTER (WHERE kind = 'delete') AS gone FROM c GROUP BY ALL),
 l AS (SELECT c.* FROM c JOIN m USING (doc, annotation) WHERE made IS NOT NULL AND (gone IS NULL OR made > gone) AND seq >= made)
 SELECT doc, annotation, arg_max(value, seq) FILTER (WHERE kind IN ('create', 'edit')) AS contents, arg_max(value, seq) FILTER (WHERE kind = 'status') AS status, count(*) FILTER (WHERE kind = 'edit') AS changes FROM l GROUP BY doc, annotation""")
def annotation_states(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") * 7 % 11 + 1).cast("int"))
    return R.annotation_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 7).alias("annotation"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("value")))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lines of documents, numbered through their pages, against those of the documents numbered one more."""
    li = lines(documents(spark, sf_dir))
    before = li.select(F.col("doc_id").alias("pair"), (F.col("page") * PAGE_LINES + F.col("line_index")).alias("idx"), "text")
    return before, before.withColumn("pair", F.col("pair") - 1).where("pair >= 0")


_SIDES = f"WITH {LINES_SQL}, b AS (SELECT doc_id AS pair, page * {PAGE_LINES} + line_index AS idx, text FROM lines), a AS (SELECT doc_id - 1 AS pair, page * {PAGE_LINES} + line_index AS idx, text FROM lines WHERE doc_id > 0)"


@query(_SIDES + " SELECT pair, idx, CASE WHEN a.text IS NULL THEN 'removed' WHEN b.text IS NULL THEN 'added' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS kind FROM b FULL JOIN a USING (pair, idx)")
def positional_diff(spark, sf_dir):
    return D.positional(*sides(spark, sf_dir))


@query(_SIDES + ", r AS (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY idx) AS k FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY idx) AS k FROM a) SELECT pair, text, r.idx AS before_idx, s.idx AS after_idx FROM r JOIN s USING (pair, text, k)")
def move_pairing(spark, sf_dir):
    return D.moves(*sides(spark, sf_dir))


@query()
def line_diff(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", split_lines(F.col("text")).alias("l"))
    after = d.select((F.col("doc_id") - 1).alias("pair"), F.col("l").alias("after"))
    return D.line_diff(d.select(F.col("doc_id").alias("pair"), F.col("l").alias("before")).join(after, "pair"))


@query("SELECT a.vec_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) > 0.5)::INT))::BIGINT AS changed, round(list_max(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS max_delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def raster_diff(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    changed, most = D.raster_difference(F.col("x"), F.col("y"), 0.5)
    return e.join(other, "vec_id").select("vec_id", changed.alias("changed"), F.round(most, 6).alias("max_delta"))


@query("SELECT name, coalesce(new, value) AS value, new IS NOT NULL AND new IS DISTINCT FROM value AS changed FROM (SELECT c_name AS name, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END END AS new FROM customer)")
def form_import(spark, sf_dir):
    from ..operators.forms import import_values

    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NEW").alias("value"))
    extra = spark.createDataFrame([("no such field", "x")], "name string, value string")
    return import_values(c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value")), new.unionByName(extra))
