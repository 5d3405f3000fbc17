"""One query per generic category that Spark provides as it is."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from ..session import shared_folder
from ..corpus import table
from .catalog import query


def sql(spark, sf_dir, text, *names):
    """Spark SQL over input tables, each under a name of its own."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


@query("SELECT p_partkey, p_size * 2 + 1 AS doubled, upper(p_brand) AS brand, p_retailprice > 1000 AS dear FROM part")
def smoke_projection(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT p_partkey, p_size * 2 + 1 AS doubled, upper(p_brand) AS brand, p_retailprice > 1000 AS dear FROM {part}", "part")


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority ILIKE '%high%' AND o_totalprice BETWEEN 1000 AND 200000 AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0) AND o_totalprice > (SELECT avg(o_totalprice) / 2 FROM orders)")
def smoke_predicates(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT o_orderkey FROM {orders} o WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority ILIKE '%high%' AND o_totalprice BETWEEN 1000 AND 200000 AND EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0) AND o_totalprice > (SELECT avg(o_totalprice) / 2 FROM {orders})", "orders", "customer")


_LO = "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"


@query(_LO)
def smoke_join_sort_merge(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").hint("merge")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(_LO)
def smoke_join_shuffled_hash(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").hint("shuffle_hash")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def smoke_join_broadcast(spark, sf_dir):
    n = table(spark, sf_dir, "nation")  # a fixed table of 25 rows
    return table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def smoke_join_left(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey", "customer", "orders")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def smoke_join_full(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM {customer} WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM {supplier} GROUP BY 1) ON c_nationkey = s_nationkey", "customer", "supplier")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def smoke_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = c.c_custkey == o.o_custkey
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("buys")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("buys")))


@query("SELECT r_name, t.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) t")
def smoke_lateral(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT r_name, t.n_name FROM {region} r, LATERAL (SELECT n_name FROM {nation} n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) t", "region", "nation")


@query("SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts GROUP BY e.event_id")
def smoke_range_join(spark, sf_dir):
    """An event and those of its user within the hour before: a range frame instead of a theta join."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("near"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed FROM lineitem GROUP BY ALL")
def smoke_aggregation(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed FROM {lineitem} GROUP BY ALL", "lineitem")


for _name, _sets in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):

    def _grouping(spark, sf_dir, sets=_sets):
        return sql(spark, sf_dir, f"SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM {{lineitem}} GROUP BY {sets}", "lineitem")

    _grouping.__name__ = f"smoke_{_name}"
    query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS gid, count(*) AS n FROM lineitem GROUP BY {_sets}")(_grouping)


@query()
def smoke_approximate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS sd, round(var_pop(l_quantity), 4) AS var, round(corr(l_quantity, l_extendedprice), 5) AS corr, round(covar_pop(l_quantity, l_extendedprice), 0) AS covar, median(l_quantity) AS median FROM lineitem GROUP BY l_returnflag")
def smoke_statistics(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS sd, round(var_pop(l_quantity), 4) AS var, round(corr(l_quantity, l_extendedprice), 5) AS corr, round(covar_pop(l_quantity, l_extendedprice), 0) AS covar, median(l_quantity) AS median FROM {lineitem} GROUP BY l_returnflag", "lineitem")


_RANK = "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)"


@query(_RANK.replace("{orders}", "orders"))
def smoke_window_ranking(spark, sf_dir):
    return sql(spark, sf_dir, _RANK, "orders")


_LAG = "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_type) OVER w AS first, nth_value(event_id, 2) OVER w AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(_LAG.replace("{events}", "events"))
def smoke_window_analytic(spark, sf_dir):
    return sql(spark, sf_dir, _LAG, "events")


_FRAME = "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {h} PRECEDING AND CURRENT ROW) AS in_hour, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before FROM {t}"


@query(_FRAME.format(h="1 HOUR", t="events"))
def smoke_window_frames(spark, sf_dir):
    return sql(spark, sf_dir, _FRAME.format(h="'1' HOUR", t="{events}"), "events")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def smoke_top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def smoke_sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(5).limit(10)


for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):

    def _set_op(spark, sf_dir, op=_op):
        return sql(spark, sf_dir, f"SELECT c_nationkey AS k FROM {{customer}} {op} SELECT s_nationkey AS k FROM {{supplier}}", "customer", "supplier")

    _set_op.__name__ = f"smoke_{_name}"
    query(f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")(_set_op)


@query("SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS \"O\", sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY l_returnflag")
def smoke_pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).sum("l_quantity")


@query("SELECT p_partkey, 'size' AS field, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def smoke_unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "field", "amount")


_CTE = "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t"


@query(_CTE)
def smoke_recursion(spark, sf_dir):
    return spark.sql(_CTE)


@query("SELECT doc_id, lpad(left(text, 5), 8, '*') AS padded, trim(substring(text, 3, 6)) AS part, translate(left(text, 20), 'aeiou', '12345') AS moved, regexp_replace(left(text, 30), '[aeiou]+', '_', 'g') AS masked, levenshtein(left(text, 10), lang) AS distance, string_split(left(text, 40), ' ')[1] AS word FROM documents WHERE length(text) = strlen(text)")
def smoke_strings(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT doc_id, lpad(left(text, 5), 8, '*') AS padded, trim(substring(text, 3, 6)) AS part, translate(left(text, 20), 'aeiou', '12345') AS moved, regexp_replace(left(text, 30), '[aeiou]+', '_') AS masked, CAST(levenshtein(left(text, 10), lang) AS BIGINT) AS distance, split(left(text, 40), ' ')[0] AS word FROM {documents} WHERE length(text) = octet_length(text)", "documents")


@query("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, (o_orderdate::DATE + 30)::VARCHAR AS later, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%Y%m%d') AS code FROM orders")
def smoke_dates(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS later, CAST(datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') AS BIGINT) AS days, date_format(o_orderdate, 'yyyyMMdd') AS code FROM {orders}", "orders")


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice)::BIGINT AS low, round(ln(l_extendedprice), 6) AS logged, round(sin(l_quantity), 6) AS sine, l_partkey & 7 AS bits, l_partkey % 10 AS rest, round(sqrt(l_quantity), 6) AS root FROM lineitem")
def smoke_math(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS low, round(ln(l_extendedprice), 6) AS logged, round(sin(l_quantity), 6) AS sine, l_partkey & 7 AS bits, l_partkey % 10 AS rest, round(sqrt(l_quantity), 6) AS root FROM {lineitem}", "lineitem")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, round(list_max(embedding)::DOUBLE, 5) AS top FROM embeddings")
def smoke_arrays(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive, round(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 4) AS norm2, round(CAST(array_max(embedding) AS DOUBLE), 5) AS top FROM {embeddings}", "embeddings")


@query("SELECT event_id, json_keys(props)[1] AS first_key, props->>('$.' || json_keys(props)[1]) AS first_value FROM events")
def smoke_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.expr("json_object_keys(props)[0]"))
    return e.select("event_id", F.col("k").alias("first_key"), F.element_at(F.from_json("props", "map<string,string>"), F.col("k")).alias("first_value"))


@query("SELECT p_partkey, length(p_name) + p_size AS score FROM part")
def smoke_pandas_udf(spark, sf_dir):
    @pandas_udf("long")
    def score(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str.len() + size

    return table(spark, sf_dir, "part").select("p_partkey", score("p_name", "p_size").alias("score"))


@query("SELECT o_custkey, count(*) * 10 AS weight FROM orders GROUP BY o_custkey")
def smoke_grouped_aggregate_udf(spark, sf_dir):
    @pandas_udf("long")
    def weight(x: pd.Series) -> int:
        return len(x) * 10

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(weight("o_orderkey").alias("weight"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def smoke_table_function(spark, sf_dir):
    @udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    spark.udtf.register("vellumine_words", Words)
    return sql(spark, sf_dir, "SELECT n_nationkey, w.word FROM {nation}, LATERAL vellumine_words(n_name) w", "nation")


@query()
def smoke_sampling(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sampleBy("l_returnflag", {"A": 0.1, "N": 0.05, "R": 0.2}, seed=7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def smoke_formats(spark, sf_dir):
    """A table through CSV, JSON, ORC, XML and text in the shared folder and back."""
    import uuid

    base = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for fmt, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("xml", {"rowTag": "nation"})):
        df.write.format(fmt).options(**options).save(f"{base}/{fmt}")
        df = spark.read.format(fmt).options(**options).schema(df.schema).load(f"{base}/{fmt}")
    df.select(F.concat_ws("|", "n_nationkey", "n_name").alias("value")).write.text(f"{base}/text")
    parts = F.split("value", "\\|")
    return spark.read.text(f"{base}/text").select(parts[0].cast("int").alias("n_nationkey"), parts[1].alias("n_name"))
