"""Tables of the document model, read from the input tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a virtual page.
PAGE_LINES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables up to so many bytes are dealt out before heavy work on their rows.
SMALL = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores: such a table may be a single row group, which one task reads.

    Tables of more than SMALL bytes have enough parts as they are; they aren't shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line, and an empty text has none."""
    bare = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "\n"))


def lines(docs: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """doc_id, page, line_index (both from 0, within document and page), text."""
    rows = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("at", "text"))
    return rows.select("doc_id", F.floor(F.col("at") / page_lines).cast("int").alias("page"), (F.col("at") % page_lines).alias("line_index"), "text")


#: The same table in DuckDB's SQL, for the oracles.
LINES_SQL = f"""
lines AS (
  SELECT doc_id, (ln // {PAGE_LINES})::INT AS page, (ln % {PAGE_LINES})::INT AS line_index, text FROM (
    SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS ln FROM (
      SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM documents WHERE length(text) > 0)))
"""
