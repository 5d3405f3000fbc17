"""Queries on streams, and on files written and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..corpus import LINES_SQL, PAGE_LINES, documents, lines, split_lines, table
from ..sources import pdf, xfdf
from ..streaming import events as E
from .catalog import query


def stream(spark, sf_dir):
    return E.replay(spark, f"{sf_dir}/events.parquet")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, sf_dir):
    return E.complete(E.windows(stream(spark, sf_dir), "1 day"), "tumbling").select(stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) - unnest([0, 1]) * INTERVAL 12 HOUR AS s FROM events) GROUP BY ALL")
def stream_sliding_windows(spark, sf_dir):
    return E.complete(E.windows(stream(spark, sf_dir), "1 day", "12 hours"), "sliding").select(stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e, "6 hours").select("user_id", stamp("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplication(spark, sf_dir):
    return E.drain(E.distinct_events(stream(spark, sf_dir), ["user_id", "event_type"], "36500 days").select("user_id", "event_type"), "distinct")


@query("SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id")
def stream_state_fold(spark, sf_dir):
    out = E.folder(spark, "fold")
    q = E.last_kinds(stream(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    q.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")).start().awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n", "kind"), "batch").alias("s")).select("user_id", "s.n", "s.kind")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_upsert(spark, sf_dir):
    return E.upsert_into(stream(spark, sf_dir).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"], "upsert").select("user_id", "event_type", "event_id")


@query("SELECT a.event_id AS first, b.event_id AS second FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR AND a.event_id <> b.event_id")
def stream_stream_join(spark, sf_dir):
    return E.drain(E.within(stream(spark, sf_dir), stream(spark, sf_dir), 2), "join")


def files(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", split_lines(F.col("text")).alias("l"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("l") / PAGE_LINES) - 1, F.lit(0)).cast("int")), lambda p: F.slice("l", p * PAGE_LINES + 1, F.lit(PAGE_LINES)))
    return pdf.written(docs.select("doc_id", chunks.alias("pages")))


@query(f"SELECT doc_id, greatest(1, ceil(n / {PAGE_LINES}.0))::INT AS page_count, greatest(1, ceil(n / {PAGE_LINES}.0))::INT AS walked, (2 + 2 * greatest(1, ceil(n / {PAGE_LINES}.0)))::INT AS objects, 1 AS revisions, 0 AS events FROM (SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS n FROM documents)")
def pdf_structure(spark, sf_dir):
    s = pdf.summaries(files(spark, sf_dir), "doc_id")
    return s.select("doc_id", F.col("page_count_declared").alias("page_count"), F.col("page_count_walked").alias("walked"), "objects", "revisions", F.size("leniency").alias("events"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_index, md5(text) AS text_md5 FROM lines")
def pdf_text(spark, sf_dir):
    return pdf.texts(files(spark, sf_dir), "doc_id").select("doc_id", "page", "line_index", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn, turn::DOUBLE AS y0, (turn + 12)::DOUBLE AS y1, role AS title FROM conversations")
def xfdf_import(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    el = xfdf.annotation_element("text", F.col("turn"), [F.lit(0.0), F.col("turn").cast("double"), F.lit(100.0), F.col("turn").cast("double") + 12], F.col("role"))
    whole = c.groupBy("conv_id").agg(F.concat(F.lit("<xfdf><annots>"), F.array_join(F.collect_list(el), ""), F.lit("</annots></xfdf>")).alias("xml"))
    return whole.select("conv_id", F.explode(xfdf.elements(F.col("xml"))).alias("e")).select("conv_id", F.col("e.page").cast("long").alias("turn"), "e.y0", "e.y1", "e.title")
