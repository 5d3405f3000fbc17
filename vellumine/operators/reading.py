"""Reading order and lines of positioned glyphs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A glyph joins a line whose first glyph is at most so far above or below.
LINE_GAP = 4.0


def ordered_content(refs: DataFrame, content: DataFrame) -> DataFrame:
    """refs: doc, seq, page, mcid, element; content: doc, page, mcid, text. References with their text, null where none was drawn."""
    return refs.join(content.select("doc", "page", "mcid", "text"), ["doc", "page", "mcid"], "left")


def missing(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("doc").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("text").isNull()).alias("missing"))


def blocks(ordered: DataFrame) -> DataFrame:
    """doc, block, element, pieces, text: neighbours of one element are one block."""
    w = Window.partitionBy("doc").orderBy("seq")
    change = F.when(F.lag("element").over(w).eqNullSafe(F.col("element")), 0).otherwise(1)
    rows = ordered.withColumn("change", change).withColumn("block", F.sum("change").over(w).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("doc", "block", "element").agg(F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(held, lambda x: x["text"]), "").alias("text"))


def glyph_lines(glyphs: Column, gap: float = LINE_GAP) -> Column:
    """glyphs: ordered array of (char, y; y null without a box). Lines as (anchor, text).

    The first glyph's height is the line's anchor; a glyph without a box joins the line that is open.
    """
    none = F.array().cast("array<struct<at:int,anchor:double>>")
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("at"), none.alias("starts"))

    def step(s: Column, g: Column) -> Column:
        y = g["y"].cast("double")
        joins = (F.size(s["starts"]) > 0) & F.coalesce(y.isNull() | (F.abs(y - s["anchor"]) <= gap), F.lit(False))
        opened = F.concat(s["starts"], F.array(F.struct(s["at"].alias("at"), y.alias("anchor"))))
        return F.struct(F.when(joins, s["anchor"]).otherwise(y).alias("anchor"), (s["at"] + 1).alias("at"), F.when(joins, s["starts"]).otherwise(opened).alias("starts"))

    def line(x: Column, after: Column) -> Column:
        shown = F.transform(F.slice(glyphs, x["at"] + 1, after["at"] - x["at"]), lambda g: g["char"])
        return F.struct(x["anchor"].alias("anchor"), F.array_join(shown, "").alias("text"))

    def whole(starts: Column) -> Column:
        end = F.array(F.struct(F.size(glyphs).alias("at"), F.lit(None).cast("double").alias("anchor")))
        return F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), end), line)

    # Only the starts of lines are collected, and once; each line's text is put together from the glyphs between two.
    folded = F.array(F.aggregate(glyphs, start, step)["starts"])
    return F.when(F.size(glyphs) == 0, F.array().cast("array<struct<anchor:double,text:string>>")).otherwise(F.element_at(F.transform(folded, whole), 1))


def boxes(glyphs: DataFrame) -> DataFrame:
    """glyphs: line, x, y, width, height. line and the box around all of it."""
    return glyphs.groupBy("line").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.lit(0.0), F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.greatest(F.lit(0.0), F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
