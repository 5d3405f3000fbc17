"""Trees as adjacency lists: closures by doubled steps, inheritance, leaves and page order."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_checkpoints

DEPTH = 64


def too_deep(depth: int) -> ValueError:
    return ValueError(f"the tree has a loop or more than {depth} levels below its root")


def closure(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes: node, parent. node, ancestor (itself too), distance.

    The steps that are joined double in length, so a chain of n steps takes log2(n) rounds. A loop, or a chain of
    more than depth steps, is an error.
    """
    with_checkpoints(nodes.sparkSession)
    up = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    jump = nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("to")).checkpoint()
    steps = 1
    while not jump.isEmpty():
        if steps > depth:
            raise too_deep(depth)
        on = jump.select(F.col("node").alias("at"), "to")
        up = up.unionByName(up.join(on, F.col("ancestor") == F.col("at")).select("node", F.col("to").alias("ancestor"), (F.col("distance") + steps).alias("distance"))).checkpoint()
        jump = jump.withColumnRenamed("to", "over").join(on, F.col("over") == F.col("at")).select("node", "to").checkpoint()
        steps *= 2
    if steps > depth and not up.where(F.col("distance") > depth).isEmpty():
        raise too_deep(depth)
    return up


def inherited(nodes: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """node, value of the nearest node upwards that has one; nodes without any are left out.

    A chain ends at the first value; what is still open jumps over its ancestor's whole way. A loop without a value,
    or a way of more than some depth steps, is an error.
    """
    with_checkpoints(nodes.sparkSession)
    state = nodes.select("node", F.when(F.col(column).isNull(), F.col("parent")).alias("up"), column).checkpoint()
    steps = 1
    while not state.where("up IS NOT NULL").isEmpty():
        if steps > 2 * depth:
            raise too_deep(depth)
        above = state.select(F.col("node").alias("at"), F.col("up").alias("over"), F.col(column).alias("found"))
        state = state.join(above, F.col("up") == F.col("at"), "left").select("node", F.col("over").alias("up"), F.coalesce(column, "found").alias(column)).checkpoint()
        steps *= 2
    return state.where(F.col(column).isNotNull()).select("node", column)


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """node, leaves at or below it."""
    leaves = nodes.join(nodes.select(F.col("parent").alias("p")).where("p IS NOT NULL").distinct(), F.col("node") == F.col("p"), "left_anti")
    return closure(nodes).join(leaves.select("node"), "node").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    return closure(nodes).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("nodes"), F.max("distance").alias("height"))


def paths(nodes: DataFrame, title: str) -> DataFrame:
    """node, depth, path of titles from the root."""
    up = closure(nodes).join(nodes.select(F.col("node").alias("ancestor"), F.col(title).alias("t")), "ancestor")
    held = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "t"))))
    return up.groupBy("node").agg(F.max("distance").alias("depth"), F.array_join(F.transform(held, lambda x: x["t"]), "/").alias("path"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges: src, dst; roots: node. Every node that the roots reach, by rounds of anti-joins until none is new."""
    with_checkpoints(edges.sparkSession)
    seen = frontier = roots.select("node").distinct()
    rounds = 0
    while True:
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        rounds += 1
        seen = seen.unionByName(frontier)
        if rounds % 16 == 0:
            seen = seen.checkpoint()


# Page order: pages have doc and page (from 0 on).


def renumbered(pages: DataFrame, *order) -> DataFrame:
    return pages.withColumn("page", (F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1).cast("int"))


def merge(parts: DataFrame) -> DataFrame:
    """parts: doc, part, page. Pages of one document, part after part."""
    return renumbered(parts, "part", "page")


def extract(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first to last, counted from 1, both included."""
    if first < 1 or last < first:
        raise ValueError("a range runs from 1 or later to a page that isn't before its start")
    return renumbered(pages.where(F.col("page").between(first - 1, last - 1)), "page")


def delete(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """Without the chosen pages; a document of which nothing would be left stays as it is (all its rows are refused)."""
    left = F.count(F.when(~F.col("page").isin(chosen), 1)).over(Window.partitionBy("doc"))
    return renumbered(pages.withColumn("left", left).where((F.col("left") == 0) | ~F.col("page").isin(chosen)).drop("left"), "page")


def duplicate(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """Each chosen page once more, right after itself."""
    copies = F.when(F.col("page").isin(chosen), 2).otherwise(1)
    return renumbered(pages.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))), "page", "copy").drop("copy")


def insert_blank(pages: DataFrame, at: int) -> DataFrame:
    """A page without content before page at, in documents that have so many; page null content marks it."""
    docs = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at)
    blank = docs.select("doc", (F.lit(at) - 0.5).alias("place"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema if f.name not in ("doc", "page")])
    rows = pages.withColumn("place", F.col("page").cast("double")).drop("page").unionByName(blank)
    return renumbered(rows, "place").drop("place")


def move(pages: DataFrame, chosen: list[int], to: int) -> DataFrame:
    """The chosen pages, in their order, before the page that now is number to."""
    place = F.when(F.col("page").isin(chosen), F.lit(to - 0.5)).otherwise(F.col("page").cast("double"))
    return renumbered(pages.withColumn("place", place), "place", "page").drop("place")


def chunks(pages: DataFrame, size: int) -> DataFrame:
    """chunk (from 1) and page within it."""
    return pages.withColumn("chunk", (F.floor(F.col("page") / size) + 1).cast("int")).withColumn("page", (F.col("page") % size).cast("int"))


def splice(base: DataFrame, other: DataFrame, at: int) -> DataFrame:
    """Pages of other put before page at (from 1) of base, per document."""
    rows = base.select("doc", F.when(F.col("page") < at - 1, 0).otherwise(2).alias("part"), "page", F.lit("base").alias("origin")).unionByName(other.select("doc", F.lit(1).alias("part"), "page", F.lit("other").alias("origin")))
    ordered = rows.withColumn("old", F.col("page"))
    return renumbered(ordered, "part", "page").drop("part")


def page_list(text: str, count: int) -> list[int]:
    """'1,3-5' as pages from 0 on, sorted and distinct; anything malformed or outside 1..count is an error."""
    out: set[int] = set()
    for piece in text.split(","):
        first, dash, last = piece.strip().partition("-")
        if not first.strip().isdigit() or dash and not last.strip().isdigit():
            raise ValueError(f"not a page or range: {piece!r}")
        a, b = int(first), int(last) if dash else int(first)
        if not 1 <= a <= b <= count:
            raise ValueError(f"outside 1 to {count}: {piece!r}")
        out.update(range(a - 1, b))
    return sorted(out)
