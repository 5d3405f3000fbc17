"""Signatures, archival checks and redaction. What can't be established is null, never a default."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document information keys that a scrub blanks.
SENSITIVE = ("Author", "Creator", "Producer", "Title", "Subject", "Keywords", "CreationDate", "ModDate", "Company")


def ranges_well_formed(ranges: Column, size: Column) -> Column:
    """Offset and length pairs: an even count, in order, apart, within size, none empty."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(True).alias("ok"))

    def step(s: Column, i: Column) -> Column:
        o, n = F.element_at(ranges, (2 * i + 1).cast("int")), F.element_at(ranges, (2 * i + 2).cast("int"))
        return F.struct((o + n).alias("end"), (s["ok"] & (o >= s["end"]) & (n > 0) & (o + n <= size)).alias("ok"))

    pairs = F.size(ranges) / 2
    run = F.aggregate(F.sequence(F.lit(0), (pairs - 1).cast("int")), start, step)["ok"]
    return F.when((F.size(ranges) == 0) | (F.size(ranges) % 2 != 0), False).otherwise(run)


def range_digest(content: Column, ranges: Column) -> Column:
    """SHA-256 of the ranges' bytes in order; pairs that leave the content are passed over."""
    piece = lambda i: F.substring(content, F.element_at(ranges, 2 * i + 1).cast("int") + 1, F.element_at(ranges, 2 * i + 2).cast("int"))
    inside = lambda i: F.element_at(ranges, 2 * i + 1) + F.element_at(ranges, 2 * i + 2) <= F.length(content)
    places = F.filter(F.sequence(F.lit(0), (F.size(ranges) / 2 - 1).cast("int")), inside)
    return F.sha2(F.aggregate(places, F.lit(b""), lambda s, i: F.concat(s, piece(i))), 256)


def verdict(has_contents: Column, ranges: Column, size: Column, moved: Column, illegal: Column, evidence: Column) -> Column:
    """valid, invalid or indeterminate, by the first of these that applies."""
    return (
        F.when(~has_contents | (F.size(ranges) == 0), "indeterminate").when(~ranges_well_formed(ranges, size), "invalid")
        .when(moved, "invalid").when(illegal, "invalid").when(~evidence, "indeterminate").otherwise("valid")
    )


def archival(content: Column) -> Column:
    """Array of what speaks against archival conformance of the bytes."""
    has = lambda s: F.contains(content, F.lit(s.encode()))
    rules = F.array(
        F.when(~has("/Metadata"), "no metadata stream"), F.when(~has("/OutputIntents"), "no output intent"),
        F.when(has("/S /Transparency"), "transparency group"), F.when(has("/Type /Font") & ~has("/FontFile"), "font not embedded"), F.when(has("/Encrypt"), "encrypted"))
    return F.filter(rules, lambda x: x.isNotNull())


def conformance(problems: Column) -> Column:
    """False with problems, else null: the check can refuse but not confirm."""
    return F.when(F.size(problems) > 0, F.lit(False))


def scrubbed(dictionary: Column) -> Column:
    """A document information dictionary with its sensitive values blanked, literal or hexadecimal."""
    out = dictionary
    for key in SENSITIVE:
        out = F.regexp_replace(out, f"/{key}\\s*\\((?:[^()\\\\]|\\\\.)*\\)", f"/{key} ()")
        out = F.regexp_replace(out, f"/{key}\\s*<[0-9A-Fa-f\\s]*>", f"/{key} <>")
    return out


def redact(lines: DataFrame, term: str) -> DataFrame:
    """Lines with the term, case ignored, replaced by as many blocks."""
    import re

    return lines.withColumn("text", F.regexp_replace("text", "(?i)" + re.escape(term), "█" * len(term)))


def verify_redaction(lines: DataFrame, removals: DataFrame) -> DataFrame:
    """lines: doc_id, page, text; removals: doc_id, page, item, kind, sample.

    doc_id, regions, confirmed, risks, passed. A removal is a risk where its sample still stands on the page, where
    the page has no lines to look at, and where it is no text; else it is confirmed.
    """
    held = lines.groupBy("doc_id", "page").agg(F.collect_list(F.lower("text")).alias("page_lines"))
    rows = removals.join(held, ["doc_id", "page"], "left")
    found = F.exists("page_lines", lambda t: F.contains(t, F.lower("sample")))
    risk = F.when(F.col("kind") != "text", "could not verify").when(F.col("page_lines").isNull(), "page missing").when(found, "text remains")
    judged = rows.withColumn("risk", risk)
    return judged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(F.col("risk").isNull()).alias("confirmed"), F.count("risk").alias("risks")
    ).withColumn("passed", F.col("risks") == 0)


def examined(count: Column) -> Column:
    return F.coalesce(count.cast("string"), F.lit("not examined"))
