"""Finding text in lines, and ranking pages."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_offset, char_at, hit_count, hits, is_boundary, is_reliable, normalize, overlaps_itself


def prepared(term: str, case_sensitive: bool) -> str:
    if case_sensitive:
        return term
    out = term.lower().replace("\u00ad", "")
    for one, many in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = out.replace(one, many)
    return out


def haystack(lines: DataFrame, term: str, case_sensitive: bool) -> tuple[DataFrame, str]:
    """Lines that hold the term, with the text that is searched in column norm."""
    term = prepared(term, case_sensitive)
    norm = F.col("text") if case_sensitive else normalize(F.col("text"))
    return lines.withColumn("norm", norm).where(F.contains("norm", F.lit(term))), term


def with_hits(rows: DataFrame, needle: str, whole_word: bool = False, overlapping: bool = False) -> DataFrame:
    """rows: norm. One row per hit of needle in norm, with its start in char_offset.

    Occurrences of a needle that can't overlap itself are numbered and their starts read off the text before them,
    without an array per line; other needles are folded.
    """
    if overlaps_itself(needle):
        return rows.withColumn("char_offset", F.explode(hits(F.col("norm"), needle, whole_word, overlapping)))
    numbered = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), hit_count(F.col("norm"), needle).cast("int"))))
    found = numbered.withColumn("char_offset", F.length(F.call_function("substring_index", F.col("norm"), F.lit(needle), F.col("nth")))).drop("nth")
    if whole_word:
        at = F.col("char_offset")
        found = found.where(is_boundary(char_at(F.col("norm"), at - 1)) & is_boundary(char_at(F.col("norm"), at + len(needle))))
    return found


def find_counts(lines: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """doc_id, page, line_index, hits: lines with at least one hit."""
    rows, term = haystack(lines, term, case_sensitive)
    return rows.select("doc_id", "page", "line_index", hit_count(F.col("norm"), term).alias("hits"))


def find_all(lines: DataFrame, term: str, case_sensitive: bool = False, whole_word: bool = False, overlapping: bool = False) -> DataFrame:
    """One row per hit: doc_id, page, line_index, char_offset, char_len, byte_offset, byte_len, matched_text.

    Offsets are of the searched (normalised) line; matches never cross a line end.
    """
    rows, term = haystack(lines, term, case_sensitive)
    found = with_hits(rows, term, whole_word, overlapping)
    return found.select(
        "doc_id", "page", "line_index", F.col("char_offset").cast("long"), F.lit(len(term)).cast("long").alias("char_len"),
        byte_offset(F.col("norm"), F.col("char_offset")).cast("long").alias("byte_offset"), F.lit(len(term.encode())).cast("long").alias("byte_len"),
        F.substring("norm", F.col("char_offset") + 1, F.lit(len(term))).alias("matched_text"))


def first_from(found: DataFrame, page: int, line: int, offset: int) -> DataFrame:
    """Per document, the first hit on the page at or after the cursor."""
    place = F.struct("line_index", "char_offset")
    return found.where(F.col("page") == page).where(place >= F.struct(F.lit(line), F.lit(offset).cast("long"))).groupBy("doc_id").agg(F.min(place).alias("p")).select("doc_id", "p.*")


def last_before(found: DataFrame, page: int, line: int, offset: int) -> DataFrame:
    """Per document, the last hit on the page that ends at or before the cursor."""
    end = F.struct("line_index", F.col("char_offset") + F.col("char_len"))
    return found.where(F.col("page") == page).where(end <= F.struct(F.lit(line), F.lit(offset).cast("long"))).groupBy("doc_id").agg(F.max(F.struct("line_index", "char_offset")).alias("p")).select("doc_id", "p.*")


def page_results(lines: DataFrame, term: str, first_window: bool = False) -> DataFrame:
    """doc_id, page, hits, reliable: pages with hits; with first_window only the first such page of each document."""
    norm = normalize(F.col("text"))
    pages = lines.groupBy("doc_id", "page").agg(F.sum(hit_count(norm, prepared(term, False))).alias("hits"), F.bool_and(is_reliable(F.col("text"))).alias("reliable")).where("hits > 0")
    if first_window:
        pages = pages.withColumn("first", F.min("page").over(Window.partitionBy("doc_id"))).where("page = first").drop("first")
    return pages


def totals(pages: DataFrame) -> DataFrame:
    """doc_id, pages, total, has_unreliable."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").alias("total"), F.bool_or(~F.col("reliable")).alias("has_unreliable"))


def selection_box(text: Column, offset: Column, length: Column, x: Column, width: Column) -> tuple[Column, Column]:
    """Left edge and width of a hit in a line's box, in proportion to characters; a hundredth of the line at least."""
    n = F.greatest(F.length(text), F.lit(1))
    return x + width * F.least(offset, n) / n, F.greatest(width * F.least(length, n - F.least(offset, n)) / n, width * 0.01)


def redaction_regions(lines: DataFrame, term: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """doc_id, page, line_index, char_offset: overlapping hits of the lower-cased (not folded) term.

    A whole word has no ASCII letter or digit next to it.
    """
    needle = term if case_sensitive else term.lower()
    norm = F.col("text") if case_sensitive else F.lower("text")
    rows = lines.withColumn("norm", norm).where(F.contains("norm", F.lit(needle)))
    rows = with_hits(rows, needle, overlapping=True)
    if whole_word:
        before, after = F.substring(F.concat(F.lit(" "), F.col("norm")), F.col("char_offset") + 1, F.lit(1)), F.substring("norm", F.col("char_offset") + len(needle) + 1, F.lit(1))
        rows = rows.where(~before.rlike("[0-9A-Za-z]") & ~after.rlike("[0-9A-Za-z]"))
    return rows.select("doc_id", "page", "line_index", F.col("char_offset").cast("long"))


TERM = "[^a-z0-9]+"


def postings(pages: DataFrame) -> DataFrame:
    """pages: key, text (several rows a key are one page). key, term, tf: runs of ASCII letters and digits of the normalised text."""
    words = pages.select("key", F.explode(F.split(normalize(F.col("text")), TERM)).alias("term")).where("term <> ''")
    return words.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def rank(pages: DataFrame, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score_milli of the best pages for the query's terms (any of them), by BM25 then key.

    pages: key, text; several rows a key are one page. Lengths and the terms' counts are taken where the rows are
    read; only they are grouped, not the words. A query without terms finds nothing.
    """
    terms = sorted({t for t in re.split(TERM, query.lower()) if t})
    # A text's words, each between blanks of its own, so that a term with its blanks is found only as a whole.
    words = F.trim(F.regexp_replace(normalize(F.col("text")), TERM, "  "))
    rows = pages.select("key", F.concat(F.lit(" "), words, F.lit(" ")).alias("w"))
    times = [((F.length("w") - F.length(F.replace(F.col("w"), F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).cast("long") for t in terms]
    gaps = F.length("w") - F.length(F.replace(F.col("w"), F.lit("  "), F.lit(" ")))
    counted = rows.select("key", F.when(F.col("w") == "  ", 0).otherwise(gaps + 1).cast("long").alias("dl"), *[x.alias(f"t{i}") for i, x in enumerate(times)])
    tf = [f"t{i}" for i in range(len(terms))]
    per = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("dl", *tf)])
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("all_words"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in tf])  # one row
    found = per.where(F.greatest(F.lit(0), F.lit(0), *tf) > 0).crossJoin(F.broadcast(stats))
    norm = k1 * (1 - b + b * F.col("dl") * F.col("n") / F.col("all_words"))
    score = sum((F.log(1 + (F.col("n") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5)) * F.col(c) * (k1 + 1) / (F.col(c) + norm) for c in tf), F.lit(0.0))
    return found.select("key", F.round(score * 1000).cast("long").alias("score_milli")).orderBy(F.desc("score_milli"), "key").limit(limit)


def upserted(index: DataFrame, records: DataFrame, by_revision: bool = True) -> DataFrame:
    """The newest record per (source, page): by revision, then order of arrival (seq); else by arrival alone."""
    order = [F.desc("revision"), F.desc("seq")] if by_revision else [F.desc("seq")]
    return index.unionByName(records).withColumn("nth", F.row_number().over(Window.partitionBy("source", "page").orderBy(*order))).where("nth = 1").drop("nth")


def removed(index: DataFrame, sources: DataFrame) -> DataFrame:
    return index.join(sources.select("source").distinct(), "source", "left_anti")
