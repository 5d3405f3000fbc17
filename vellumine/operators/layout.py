"""Page geometry: offsets, visible regions, tiles, zoom steps and rectangles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The zoom steps.
SCALES = (0.25, 0.33, 0.5, 0.67, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
TILE = 256


def effective_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def page_offsets(pages: DataFrame, gap: float) -> DataFrame:
    """pages: doc, page, height. Adds y: heights and gaps of the pages before."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("y", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0.0)))


def spread_offsets(pages: DataFrame, gap: float) -> DataFrame:
    """Facing pages: pages 2k and 2k + 1 share a row as high as the higher one."""
    spread = F.floor(F.col("page") / 2)
    rows = pages.withColumn("spread", spread).groupBy("doc", "spread").agg(F.max("height").alias("row_height"))
    before = Window.partitionBy("doc").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("y", F.coalesce(F.sum(F.col("row_height") + gap).over(before), F.lit(0.0)))
    return pages.withColumn("spread", spread).join(rows, ["doc", "spread"]).drop("spread", "row_height")


def current_page(pages: DataFrame, centre: float) -> DataFrame:
    """doc, page whose middle is nearest to centre; the first of equals."""
    gap = F.abs(F.col("y") + F.col("height") / 2 - centre)
    return pages.groupBy("doc").agg(F.min_by("page", F.struct(gap, "page")).alias("page"))


def nearest_scale(scale: Column) -> Column:
    """The nearest step; of two equally near, the lower."""
    steps = F.array(*map(F.lit, SCALES))
    return F.array_min(F.transform(steps, lambda x: F.struct(F.abs(scale - x).alias("gap"), x.alias("step"))))["step"]


def visible(pages: DataFrame, top: float, height: float) -> DataFrame:
    """Pages that meet the half-open band top..top + height, with the part that is seen, cut to whole units."""
    start, end = F.greatest(F.col("y"), F.lit(top)), F.least(F.col("y") + F.col("height"), F.lit(top + height))
    return pages.where((F.col("y") < top + height) & (F.col("y") + F.col("height") > top)).select("doc", "page", (start - F.col("y")).cast("long").alias("from_y"), (end - start).cast("long").alias("seen"))


def tiles(regions: DataFrame, edge: int = TILE) -> DataFrame:
    """regions: id, x, y, width, height (whole numbers). One row per tile that a region touches, clipped."""
    rows = regions.where("width > 0 AND height > 0")
    span = lambda a, n: F.sequence(F.floor(a / edge), F.floor((a + n - 1) / edge))
    rows = rows.withColumn("col", F.explode(span(F.col("x"), F.col("width")))).withColumn("row", F.explode(span(F.col("y"), F.col("height"))))
    cut = lambda a, n, i: F.least(a + n, (i + 1) * edge) - F.greatest(a, i * edge)
    return rows.select("id", "col", "row", cut(F.col("x"), F.col("width"), F.col("col")).cast("long").alias("w"), cut(F.col("y"), F.col("height"), F.col("row")).cast("long").alias("h"))


def prefetch_margin(velocity: Column, tile: float, least: int, most: int) -> Column:
    part = F.least(F.abs(velocity) / tile / 1.33, F.lit(1.0))
    return F.round(least + part * (most - least)).cast("int")


def smoothed(samples: Column, weight: float = 0.3) -> Column:
    """Exponential mean over an ordered array, starting from 0."""
    return F.aggregate(samples, F.lit(0.0), lambda v, x: weight * x + (1 - weight) * v)


def fit(width: Column, height: Column, view_width: float, view_height: float, low: float = 0.1, high: float = 6.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.least(view_width / width, view_height / height)))


def normalized(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.0) -> Column:
    """Two corners as x, y, width, height."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.greatest(F.abs(x1 - x0), F.lit(least)).alias("width"), F.greatest(F.abs(y1 - y0), F.lit(least)).alias("height"))


def overlaps(a, b) -> Column:
    """Whether two rectangles (structs or dicts of columns) share more than an edge."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def overlap_join(left: DataFrame, right: DataFrame, how: str, cell: float = 100.0) -> DataFrame:
    """left and right: page, id, x, y, width, height. Rows of left with (semi) or without (anti) an overlap on their page.

    Both sides go to the grid cells they touch, so that a page with very many rectangles is dealt out by cell.
    """

    def celled(df: DataFrame, p: str) -> DataFrame:
        span = lambda a, n: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(n)) / cell))
        named = df.select(*[F.col(c).alias(p + c) for c in ("page", "id", "x", "y", "width", "height")])
        return named.withColumn(p + "cx", F.explode(span(p + "x", p + "width"))).withColumn(p + "cy", F.explode(span(p + "y", p + "height")))

    a, b = celled(left, "a_"), celled(right, "b_")
    box = lambda p: {k: F.col(p + k) for k in ("x", "y", "width", "height")}
    met = a.join(b, (F.col("a_page") == F.col("b_page")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & overlaps(box("a_"), box("b_")), "left_semi").select(F.col("a_id").alias("id"), F.col("a_page").alias("page")).distinct()
    return left.join(met, ["id", "page"], "left_semi" if how == "semi" else "left_anti")


def queue_places(requests: DataFrame, priority: str, order: str) -> DataFrame:
    """Adds place: from 1 on by priority, then order.

    Rows are numbered within their priority; what stands before a priority comes from the counts of the few priorities.
    """
    counts = requests.groupBy(priority).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col(priority).alias("_p"), (F.sum("n").over(Window.orderBy(priority)) - F.col("n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(priority).orderBy(order))
    return requests.withColumn("_nth", nth).join(F.broadcast(before), F.col(priority) == F.col("_p")).withColumn("place", F.col("_before") + F.col("_nth")).drop("_p", "_before", "_nth")
