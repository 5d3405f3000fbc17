"""Appearance streams: what an annotation or a form widget looks like, as drawing operators of a page.

Numbers are written as the file format's writers do: colours with three decimals, places with one.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Annotation kinds that have an appearance.
KINDS = ("highlight", "underline", "strikeout", "squiggly", "note", "freetext", "ink", "line", "arrow", "rectangle", "ellipse", "polygon", "polyline", "stamp", "redaction")
#: Widget kinds.
WIDGETS = ("text", "combo", "list", "checkbox", "radio", "button", "signature")
#: Control points of a quarter circle, wave and head of lines, fold of a note (shares or points).
CIRCLE, WAVE, HEAD, FOLD = 0.5522847498, (4.0, 3.0, -1.0), (10.0, 0.5), 0.3
#: What stands for on in a widget's text.
ON = ("Yes", "On", "1")
_ESCAPES = str.maketrans({"(": "\\(", ")": "\\)", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"})

Point = tuple[float, float]


class Pen:
    """Collects operators, a line each."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def put(self, *parts: object) -> Pen:
        self.lines.append(" ".join(f"{p:.1f}" if isinstance(p, float) else str(p) for p in parts))
        return self

    def color(self, rgb: Sequence[float]) -> Pen:
        self.lines.append(" ".join(f"{c:.3f}" for c in rgb) + " rg")
        return self

    def path(self, points: Sequence[Point], end: str) -> Pen:
        """A line through points on one line of output."""
        steps = [f"{x:.1f} {y:.1f} {'l' if i else 'm'}" for i, (x, y) in enumerate(points)]
        self.lines.append(" ".join([*steps, end]))
        return self

    def steps(self, points: Sequence[Point], *end: str) -> Pen:
        """A line through points, each on a line of output; end goes on the last one or on its own."""
        self.lines += [f"{x:.1f} {y:.1f} {'l' if i else 'm'}" for i, (x, y) in enumerate(points)]
        self.lines += end
        return self

    def text(self, words: str, size: str, color: str, x: float, y: float) -> Pen:
        return self.put("BT").put(f"/F1 {size} Tf").put(color).put(x, y, "Td").put(f"({words.translate(_ESCAPES)}) Tj").put("ET")

    def done(self) -> bytes:
        return "".join(f"{line}\n" for line in self.lines).encode()


def appearance(kind: str, rect: tuple[float, float, float, float], color: Sequence[float] = (0.0, 0.0, 0.0), border: float = 1.0, text: str = "", strokes: Sequence[Sequence[Point]] = ()) -> bytes:
    """rect: left, bottom, width, height. strokes: of ink all, of other drawn lines the first. Unknown kinds are an error."""
    if kind not in KINDS:
        raise ValueError(f"no appearance for {kind}")
    x, y, w, h = map(float, rect)
    pen, points = Pen(), list(strokes[0]) if len(strokes) else []
    if kind in ("highlight", "underline", "strikeout", "squiggly"):
        pen.color(color).put(x, y, w, h, "re f")
        if kind != "highlight":
            pen.color(color).put("1 w")
            low = y + h / 2 if kind == "strikeout" else y + 2
            between: list[Point] = []
            if kind == "squiggly":
                step, up, down = WAVE
                at = x + step
                while at < x + w - step:
                    between.append((at, low + (down if len(between) % 2 else up)))
                    at += step
            pen.path([(x, low), *between, (x + w, low)], "S")
    elif kind == "note":
        fold = min(w, h) * FOLD
        pen.color(color).put("1 0 0 1", x, y, "cm").put("0 0", w, h, "re f").put("1 g")
        pen.path([(x + w - fold, y + h), (x + w, y + h - fold), (x + w - fold, y + h - fold)], "f")
    elif kind == "freetext":
        pen.put("1 1 1 rg").put(x, y, w, h, "re f").color(color).put(float(border), "w").put(x, y, w, h, "re S")
        if text:
            pen.text(text, "10", " ".join(f"{c:.3f}" for c in color) + " rg", x + 4, y + h - 14)
    elif kind == "ink":
        pen.color(color).put(float(border), "w").put("1 J").put("1 j")
        for stroke in strokes:
            if len(stroke):
                pen.steps(stroke, "S")
    elif kind in ("line", "arrow"):
        if len(points) >= 2:
            (x1, y1), (x2, y2) = points[:2]
            pen.color(color).put(float(border), "w").put(float(x1), float(y1), "m").put(float(x2), float(y2), "l S")
            if kind == "arrow":
                size, spread = HEAD
                turn = math.atan2(y2 - y1, x2 - x1)
                pen.path([(x2, y2), *[(x2 - size * math.cos(turn + s), y2 - size * math.sin(turn + s)) for s in (-spread, spread)]], "f")
    elif kind == "rectangle":
        pen.color(color).put(float(border), "w").put(x, y, w, h, "re S")
    elif kind == "ellipse":
        cx, cy, rx, ry = x + w / 2, y + h / 2, w / 2, h / 2
        pen.color(color).put(float(border), "w").put(cx, cy - ry, "m")
        # From each quarter's start, a unit vector, to the next one, a quarter turn further.
        for i, (a, b) in enumerate(((0, -1), (1, 0), (0, 1), (-1, 0))):
            c, d = -b, a
            curve = [(a + CIRCLE * c, b + CIRCLE * d), (c + CIRCLE * a, d + CIRCLE * b), (c, d)]
            pen.put(*[v for px, py in curve for v in (cx + rx * px, cy + ry * py)], "c S" if i == 3 else "c")
    elif kind in ("polygon", "polyline"):
        if points:
            pen.color(color).put(float(border), "w").steps(points, "h S" if kind == "polygon" else "S")
    elif kind == "stamp":
        pen.put("1 0 0 rg").put(x, y, w, h, "re f").put("1 1 1 rg").put("2 w").put(x, y, w, h, "re S")
        if text:
            pen.text(text, "14", "1 1 1 rg", x + 4, y + h / 2)
    else:
        pen.color(color).put(x, y, w, h, "re f").text("Redacted", "10", "1 1 1 rg", x + 4, y + h / 2)
    return pen.done()


def widget(kind: str, width: float, height: float, value: str | None = None, name: str = "", font_size: float | None = None, password: bool = False) -> bytes:
    """A form widget in its own coordinates, from the lower left corner. value: as it is displayed, None without one."""
    if kind not in WIDGETS:
        raise ValueError(f"no widget of kind {kind}")
    pen, w, h, shown = Pen(), float(width), float(height), value or ""

    def box(fill: str, stroke: str, line: str) -> None:
        pen.put(f"{fill} rg").put("0 0", w, h, "re f").put(f"{stroke} RG").put(f"{line} w").put("0 0", w, h, "re S")

    if kind in ("checkbox", "radio"):
        w, h = max(w, 8.0), max(h, 8.0)
        box("1 1 1", "0 0 0", "1")
        if shown in ON:
            pen.put("0 0 0 RG").put("1.5 w").put(w * 0.2, h * 0.5, "m").put(w * 0.4, h * 0.25, "l").put(w * 0.8, h * 0.8, "l S")
    elif kind == "button":
        box("0.9 0.9 0.9", "0 0 0", "1")
        if shown or name:
            pen.text(shown or name, "9", "0 0 0 rg", 2.0, max(h - 10, 2.0))
    elif kind == "signature":
        box("1 1 1", "0.5 0.5 0.5", "0.5")
        pen.text(shown or "Sign", "9", "0.3 0.3 0.3 rg", 4.0, max(h - 12, 2.0))
    else:
        size = min(max(font_size if font_size is not None else 10.0, 6.0), 24.0)
        box("1 1 1", "0 0 0", "0.5")
        shown = "•" * min(len(shown), 32) if password else shown
        if shown:
            pen.text(shown, f"{size:.1f}", "0 0 0 rg", 2.0, max(h - size, 2.0))
    return pen.done()


def streams(annotations: DataFrame, key: str) -> DataFrame:
    """annotations: key, kind, x, y, width, height, color (array of three), border, text, strokes (arrays of x and y).

    key, kind and stream (null for kinds without an appearance). Null texts and strokes count as none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            made = []
            for kind, x, y, w, h, c, b, text, strokes in zip(*(t[n] for n in ("kind", "x", "y", "width", "height", "color", "border", "text", "strokes"))):
                lines = [[(p["x"], p["y"]) for p in s] for s in strokes] if strokes is not None else []
                made.append(appearance(kind, (x, y, w, h), list(c), b, text or "", lines) if kind in KINDS else None)
            yield pd.DataFrame({key: t[key], "kind": t["kind"], "stream": made})

    rows = annotations.select(key, "kind", "x", "y", "width", "height", "color", "border", "text", "strokes")
    return rows.mapInPandas(run, f"{key} {dict(annotations.dtypes)[key]}, kind string, stream binary")


def widgets(fields: DataFrame, key: str) -> DataFrame:
    """fields: key, kind, width, height, value, name, font_size, password. key and stream (null for kinds that don't exist)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            made = [widget(k, w, h, v, n or "", None if pd.isna(s) else s, bool(p)) if k in WIDGETS else None for k, w, h, v, n, s, p in zip(*(t[c] for c in ("kind", "width", "height", "value", "name", "font_size", "password")))]
            yield pd.DataFrame({key: t[key], "stream": made})

    rows = fields.select(key, "kind", "width", "height", "value", "name", "font_size", "password")
    return rows.mapInPandas(run, f"{key} {dict(fields.dtypes)[key]}, stream binary")
