"""Comparing two versions: by position, by longest common subsequence with moves, and as rasters."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines a side that are aligned; beyond, lines are compared by position.
ALIGNED = 2000


def positional(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both: pair, idx, text. pair, idx, kind (same, changed, removed, added)."""
    b, a = before.select("pair", "idx", F.col("text").alias("b")), after.select("pair", "idx", F.col("text").alias("a"))
    kind = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return b.join(a, ["pair", "idx"], "full_outer").select("pair", "idx", kind.alias("kind"))


def moves(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Both: pair, idx, text. The k-th removal of a text pairs with its k-th addition: pair, text, before_idx, after_idx."""
    nth = F.row_number().over(Window.partitionBy("pair", "text").orderBy("idx"))
    r = removed.withColumn("k", nth).select("pair", "text", "k", F.col("idx").alias("before_idx"))
    a = added.withColumn("k", nth).select("pair", "text", "k", F.col("idx").alias("after_idx"))
    return r.join(a, ["pair", "text", "k"]).drop("k")


def align(before: list[str], after: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(same, removed or added; index before; index after) in order; of equal choices a removal comes first.

    A common beginning matches line by line and needs no table; a common end may not, where lines repeat.
    """
    head = 0
    while head < min(len(before), len(after)) and before[head] == after[head]:
        head += 1
    if head:
        rest = align(before[head:], after[head:])
        return [("same", i, i) for i in range(head)] + [(k, i if i is None else i + head, j if j is None else j + head) for k, i, j in rest]
    n, m = len(before), len(after)
    if not n or not m:
        return [("removed", x, None) for x in range(n)] + [("added", None, x) for x in range(m)]
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(x, len(ids)) for x in side], np.int64) for side in (before, after))
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):  # common lines of what is left on both sides
        best = np.maximum(table[i + 1, :m], np.where(b == a[i], table[i + 1, 1:] + 1, 0))
        table[i, :m] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            out.append(("removed", i, None))
            i += 1
        else:
            out.append(("added", None, j))
            j += 1
    return out + [("removed", x, None) for x in range(i, n)] + [("added", None, x) for x in range(j, m)]


def diff(before: list[str], after: list[str], aligned: int = ALIGNED) -> tuple[list[tuple[str, str, int | None, int | None]], str]:
    """(kind, text, before, after) with moves at their removal's place, and how lines were matched."""
    quality = "aligned"
    if max(len(before), len(after)) > aligned:
        quality, steps = "positional", []
        for i in range(max(len(before), len(after))):
            if i < min(len(before), len(after)) and before[i] == after[i]:
                steps.append(("same", i, i))
            else:
                steps += [("removed", i, None)] * (i < len(before)) + [("added", None, i)] * (i < len(after))
    else:
        steps = align(before, after)
    waiting: dict[str, list[int]] = {}
    for kind, _, j in steps:
        if kind == "added":
            waiting.setdefault(after[j], []).append(j)
    out, taken = [], set()
    for kind, i, j in steps:
        if kind == "removed" and waiting.get(before[i]):
            j = waiting[before[i]].pop(0)
            taken.add(j)
            out.append(("moved", before[i], i, j))
        else:
            out.append((kind, after[j] if kind == "added" else before[i], i, j))
    return [x for x in out if not (x[0] == "added" and x[3] in taken)], quality


def line_diff(sides: DataFrame, aligned: int = ALIGNED) -> DataFrame:
    """sides: pair, before (array of lines), after. pair, seq, kind, text, before_index, after_index, quality.

    Memory of a pair is bounded: at most aligned lines a side are aligned.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for pair, b, a in zip(pdf["pair"], pdf["before"], pdf["after"]):
                steps, quality = diff(list(b), list(a), aligned)
                out += [(pair, k, kind, text, i, j, quality) for k, (kind, text, i, j) in enumerate(steps)]
            frame = pd.DataFrame(out, columns=["pair", "seq", "kind", "text", "before_index", "after_index", "quality"])
            yield frame.astype({"before_index": "Int64", "after_index": "Int64"})

    return sides.select("pair", "before", "after").mapInPandas(run, "pair long, seq int, kind string, text string, before_index int, after_index int, quality string")


def raster_difference(a: Column, b: Column, tolerance: float) -> tuple[Column, Column]:
    """Changed elements (difference above tolerance) and largest difference of two arrays; the longer one's tail is changed."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    changed = F.size(F.filter(gaps, lambda d: d.isNull() | (d > tolerance)))
    return changed.cast("long"), F.coalesce(F.array_max(F.filter(gaps, lambda d: d.isNotNull())), F.lit(0.0))


def image_difference(a: bytes, size_a: tuple[int, int], b: bytes, size_b: tuple[int, int], tolerance: int = 8) -> dict:
    """Pixels of two RGBA images of which any channel differs by more than tolerance, and what only one covers."""
    x, y = (np.frombuffer(d, np.uint8).reshape(h, w, 4).astype(np.int16) for d, (w, h) in ((a, size_a), (b, size_b)))
    h, w = min(x.shape[0], y.shape[0]), min(x.shape[1], y.shape[1])
    gap = np.abs(x[:h, :w] - y[:h, :w])
    total = max(x.shape[0], y.shape[0]) * max(x.shape[1], y.shape[1])
    changed = int((gap > tolerance).any(axis=2).sum()) + total - h * w
    return {"changed_pixels": changed, "total_pixels": total, "max_delta": int(gap.max(initial=0)), "geometry_differs": size_a != size_b, "changed_fraction": changed / total if total else 0.0}
