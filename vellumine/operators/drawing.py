"""Stamps, annotation kinds, page patches, raster files, and folds over a view's history."""
from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pdf_escape

#: Annotation kinds, their names in files, and default colours.
ANNOTATIONS = (
    ("highlight", "Highlight", "#FFFF00"), ("underline", "Underline", "#00FF00"), ("strikeout", "StrikeOut", "#FF0000"), ("squiggly", "Squiggly", "#FF00FF"), ("note", "Text", "#FFFF00"),
    ("freetext", "FreeText", "#000000"), ("ink", "Ink", "#0000FF"), ("line", "Line", "#FF0000"), ("square", "Square", "#FF0000"), ("circle", "Circle", "#FF0000"), ("stamp", "Stamp", "#FF0000"),
    ("polygon", "Polygon", "#FF0000"), ("caret", "Caret", "#0000FF"),
)
#: Where a stamp may stand, as shares of what is left of width and height.
ANCHORS = {"top-left": (0.0, 1.0), "top-center": (0.5, 1.0), "top-right": (1.0, 1.0), "center": (0.5, 0.5), "bottom-left": (0.0, 0.0), "bottom-center": (0.5, 0.0), "bottom-right": (1.0, 0.0)}


def stamp(text: Column, anchor: str, width: float, height: float, size: float = 12.0, margin: float = 36.0, degrees: float = 0.0) -> Column:
    """A content stream that writes text at an anchor; half the font size stands for a character's width."""
    sx, sy = ANCHORS[anchor]
    x = margin + sx * (width - 2 * margin - F.length(text) * size * 0.5)
    y = F.lit(margin + sy * (height - 2 * margin - size))
    a = F.radians(F.lit(degrees))
    return F.format_string(f"q BT /F1 {size:.1f} Tf %.4f %.4f %.4f %.4f %.2f %.2f Tm (%s) Tj ET Q", F.cos(a), F.sin(a), -F.sin(a), F.cos(a), x, y, pdf_escape(text))


def kinds(annotations: DataFrame) -> DataFrame:
    """annotations: kind. Adds subtype and color, null for kinds that don't exist."""
    known = annotations.sparkSession.createDataFrame(list(ANNOTATIONS), "kind string, subtype string, color string")
    return annotations.join(F.broadcast(known), "kind", "left")


def with_references(pages: DataFrame, new: DataFrame) -> DataFrame:
    """pages: doc, page, refs (array); new: doc, page, ref. New references stand before those that are there."""
    held = new.groupBy("doc", "page").agg(F.sort_array(F.collect_list("ref")).alias("more"))
    none = F.array().cast("array<bigint>")
    return pages.join(held, ["doc", "page"], "left").select("doc", "page", F.concat(F.coalesce("more", none), "refs").alias("refs"))


def png(pixels: bytes, width: int, height: int) -> bytes:
    """RGBA rows as a PNG file."""
    if len(pixels) != width * height * 4:
        raise ValueError("pixels don't fill the image")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[i : i + width * 4] for i in range(0, len(pixels), width * 4))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def history(visits: Column, most: int = 50) -> Column:
    """visits: ordered array of (kind, page, scale); kinds visit, back, forward. (pages, cursor) at the end.

    A visit to the page shown replaces its scale; any other cuts what lies ahead. At most ``most`` pages are kept.
    """
    empty = F.array().cast("array<struct<page:bigint,scale:double>>")
    start = F.struct(empty.alias("pages"), F.lit(0).alias("cursor"))

    def step(s: Column, v: Column) -> Column:
        n, at = F.size(s["pages"]), s["cursor"]
        shown = F.try_element_at(s["pages"], at)
        new = F.array(F.struct(v["page"].alias("page"), v["scale"].alias("scale")))
        same = (n > 0) & (shown["page"] == v["page"])
        cut = F.slice(s["pages"], F.lit(1), F.when(same, at - 1).otherwise(at))
        visited = F.concat(cut, F.when(same, F.concat(new, F.slice(s["pages"], at + 1, F.greatest(n - at, F.lit(0))))).otherwise(new))
        over = F.greatest(F.size(visited) - most, F.lit(0))
        kept = F.slice(visited, over + 1, F.lit(most))
        visit = v["kind"] == "visit"
        moved = F.when(v["kind"] == "back", F.greatest(at - 1, F.least(F.lit(1), n))).otherwise(F.least(at + 1, n))
        return F.struct(F.when(visit, kept).otherwise(s["pages"]).alias("pages"), F.when(visit, F.when(same, at).otherwise(F.size(kept))).otherwise(moved).alias("cursor"))

    return F.aggregate(visits, start, step)


def momentum(velocity: float, dt: float, idle: float, position: float, low: float, high: float, decay: float = 4.0, stiffness: float = 200.0, damping: float = 28.0) -> tuple[float, float]:
    """One step of scrolling: exponential decay after 50 ms idle, a damped spring beyond the edges. (position, velocity)."""
    import math

    if idle > 0.05:
        velocity *= math.exp(-decay * dt)
    beyond = low - position if position < low else high - position if position > high else 0.0
    if beyond:
        velocity += (stiffness * beyond - damping * velocity) * dt
    return position + velocity * dt, velocity


def slots(requests: list[tuple[str, int]], size: int) -> list[int]:
    """Slots of a pool by a list of (alloc, generation) and (ready, slot): a free one first, else the oldest generation's."""
    held: dict[int, int] = {}
    out = []
    for kind, n in requests:
        if kind == "ready":
            held.pop(n, None)
            continue
        free = [i for i in range(size) if i not in held]
        slot = free[0] if free else min(held, key=lambda i: (held[i], i))
        held[slot] = n
        out.append(slot)
    return out
