"""Sinks: pages as HTML, text or JSON, and staged publishing of files."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape

NO_TEXT = "<p>No text on this page.</p>"


def page_html(lines: DataFrame) -> DataFrame:
    """doc_id, page, html: a paragraph per line that isn't blank."""
    shown = F.when(F.trim("text") != "", F.concat(F.lit("<p>"), html_escape(F.col("text")), F.lit("</p>")))
    held = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("line_index", shown.alias("p")))))
    return lines.groupBy("doc_id", "page").agg(held.alias("h")).select("doc_id", "page", F.when(F.size("h") == 0, F.lit(NO_TEXT)).otherwise(F.array_join(F.transform("h", lambda x: x["p"]), "\n")).alias("html"))


def page_text(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, page, text: lines in order."""
    held = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(held, lambda x: x["text"]), sep).alias("text"))


def publish(df: DataFrame, target: str, accept, fmt: str = "parquet") -> int:
    """Write to a staging folder beside target, check what can be read back, then rename; never overwrites.

    accept: takes the DataFrame as read back and says whether it may be published. Returns its row count.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    goal = path(target)
    fs = goal.getFileSystem(conf)
    if fs.exists(goal):
        raise FileExistsError(target)
    staged = f"{target}.staging-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    back = spark.read.format(fmt).load(staged)
    if not accept(back):
        fs.delete(path(staged), True)
        raise ValueError("what was written failed its check; nothing was published")
    count = back.count()
    if not fs.rename(path(staged), goal):
        fs.delete(path(staged), True)
        raise FileExistsError(target)
    return count
