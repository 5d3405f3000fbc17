"""Comment threads: a root (turn 0) and its direct replies."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threads(comments: DataFrame) -> DataFrame:
    """comments: thread, ord (0 is the root), author, text. One row per root with its replies in order."""
    roots = comments.where("ord = 0").select("thread", F.col("author").alias("root_author"), F.col("text").alias("root_text"))
    replies = comments.where("ord > 0").groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("ord", "author", "text"))).alias("replies"))
    return roots.join(replies, "thread", "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<struct<ord:bigint,author:string,text:string>>")))


def thread_facts(comments: DataFrame) -> DataFrame:
    """thread, comments, last_author (of the last reply, else of the root)."""
    return comments.groupBy("thread").agg(F.count(F.lit(1)).alias("comments"), F.max_by("author", "ord").alias("last_author"), F.bool_or(F.col("ord") == 0).alias("rooted")).where("rooted").drop("rooted")


def replies_with_root(comments: DataFrame) -> DataFrame:
    """Each reply beside its root; replies without a root drop out."""
    roots = comments.where("ord = 0").select("thread", F.col("author").alias("root_author"))
    return comments.where("ord > 0").join(roots, "thread")


def filter_exact(comments: DataFrame, author: str | None = None, is_reply: bool | None = None, thread: int | None = None) -> DataFrame:
    """Whole names, case ignored; every condition is optional."""
    out = comments
    if author is not None:
        out = out.where(F.lower("author") == author.lower())
    if is_reply is not None:
        out = out.where((F.col("ord") > 0) == is_reply)
    if thread is not None:
        out = out.where(F.col("thread") == thread)
    return out


def filter_threads(comments: DataFrame, author_part: str) -> DataFrame:
    """Threads whose root's author holds a part, case ignored."""
    return threads(comments).where(F.contains(F.lower("root_author"), F.lit(author_part.lower())))


def summary(comments: DataFrame) -> DataFrame:
    """thread, summary: the root and, indented, each reply, with their whole texts."""
    line = lambda a, t: F.concat(a, F.lit(": "), t)
    body = F.transform("replies", lambda r: F.concat(F.lit("\n  "), line(r["author"], r["text"])))
    return threads(comments).select("thread", F.concat(line(F.col("root_author"), F.col("root_text")), F.array_join(body, "")).alias("summary"))


def annotation_states(commands: DataFrame) -> DataFrame:
    """commands: doc, annotation, seq, kind (create, edit, delete, status), value. doc, annotation, contents, status, changes.

    An annotation is there if its last creation came after its last deletion. Its contents are of its last creation or
    edit, its status (null before any) of the last status since it was created; changes counts its edits since then.
    """
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    made = F.max(at("create")).over(Window.partitionBy("doc", "annotation"))
    gone = F.max(at("delete")).over(Window.partitionBy("doc", "annotation"))
    live = commands.withColumns({"made": made, "gone": gone}).where("made IS NOT NULL AND (gone IS NULL OR made > gone) AND seq >= made")
    return live.groupBy("doc", "annotation").agg(F.max_by("value", at("create", "edit")).alias("contents"), F.max_by("value", at("status")).alias("status"), F.count_if(F.col("kind") == "edit").alias("changes"))
