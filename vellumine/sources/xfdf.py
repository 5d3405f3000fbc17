"""Annotations as XFDF text, written with column expressions and read back with XPath-free patterns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import xml_escape, xml_unescape

#: The annotation elements that are read.
ELEMENTS = ("text", "highlight", "underline", "strikeout", "squiggly", "freetext", "square", "circle", "line", "ink", "stamp", "polygon", "polyline", "caret")


def annotation_element(tag: str, page: Column, corners: list[Column], title: Column) -> Column:
    """One element: page from 0, the rectangle's two corners with one decimal, and the author."""
    rect = F.format_string("%.1f,%.1f,%.1f,%.1f", *corners)
    return F.concat(F.lit(f'<{tag} page="'), page.cast("string"), F.lit('" rect="'), rect, F.lit('" title="'), xml_escape(title), F.lit('"/>'))


def elements(xml: Column) -> Column:
    """Array of (tag, page, x0, y0, x1, y1, title); malformed numbers are 0."""
    found = F.regexp_extract_all(xml, F.lit("<(?:" + "|".join(ELEMENTS) + ")\\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>"), F.lit(0))

    def attribute(e: Column, name: str) -> Column:
        return F.regexp_extract(e, f'\\b{name}="([^"]*)"', 1)

    def corner(e: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(F.split(attribute(e, "rect"), ","), F.lit(i)).try_cast("double"), F.lit(0.0))

    return F.transform(found, lambda e: F.struct(
        F.regexp_extract(e, "<([a-z]+)", 1).alias("tag"), F.coalesce(attribute(e, "page").try_cast("int"), F.lit(0)).alias("page"),
        corner(e, 1).alias("x0"), corner(e, 2).alias("y0"), corner(e, 3).alias("x1"), corner(e, 4).alias("y1"), xml_unescape(attribute(e, "title")).alias("title")))
