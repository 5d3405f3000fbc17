"""Mixing sources to target weights by entropy balancing, on DataFrame functions alone.

The rate w of a document minimises sum(w log w - w + 1) subject to sum(size * w) = target for its
source and 0 <= w <= 3. The dual has one multiplier per source; its stationary point gives the tilt
w = min(3, exp(lambda * size / mean size of the source)). Newton steps on the dual, held inside a
bracket, run over the table of (source, size, number of documents), which is all that the sums need
and does not grow with the number of documents of a size.

Rounding: within a source the sizes go from long to short, and each size takes as many copies as
bring the running total nearest to the running target, without passing the whole target and without
leaving more than shorter documents can give; what one size leaves over, shorter ones make up. Documents of one size share those copies evenly, in an order drawn from a hash of doc_id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, text_of, written

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 100
TOLERANCE = 1e-9
#: A table of at most so many sources is sent to every task and written as one file.
SENT = 10_000
#: Sizes folded at a time; results are appended once for so many.
FOLDED = 512
#: Documents of one size in one source that a task ranks together.
RANKED = 20_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size (one row per source, null a source too). Adds target.

    Where c is the level at which min(cap * size, c * weight) sums to all sizes, that minimum is the target:
    resharing the excess by weight ends there. The level follows from prefix sums over the sources ordered
    by the level at which each is full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double"))
    full = rows.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = full.withColumn("level", level)
    c = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("c", c).select(
        "source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("c") * F.col("weight"), F.lit(0.0))).alias("target")
    )


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def rate(multiplier: Column, scaled: Column, cap: int) -> Column:
    """exp(multiplier * scaled size), at most cap."""
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * scaled, F.lit(50.0))))


def solve(histogram: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """histogram: source, size, docs. Returns source, source_size, target, mean_size, multiplier.

    Safeguarded Newton: a step that leaves the bracket is replaced by the bracket's middle. A source that isn't
    solved after ``steps`` steps is an error.
    """
    means = histogram.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean_size"), F.min("size").alias("least_size")
    ).withColumnRenamed("source", "s")
    start = targets.join(means, same(F.col("source"), F.col("s")), "left").drop("s")
    # At the ends of the bracket every rate is at the cap, or every rate is so small that the sum is below any target.
    span = F.col("mean_size") / F.col("least_size")
    state = written(
        start.select("source", "source_size", "target", "mean_size", F.lit(0.0).alias("multiplier"), (-60.0 * span).alias("low"), ((F.log(F.lit(float(cap))) + 1e-6) * span).alias("high"), F.lit(False).alias("done")), "mix-start")
    few = state.count() <= SENT
    sides = F.broadcast if few else (lambda df: df)
    for _ in range(steps):
        live = state.where("not done and target > 0 and target < %d * source_size" % cap)
        z = F.col("size") / F.col("mean_size")
        w = rate(F.col("multiplier"), z, cap)
        sums = histogram.where("size > 0").withColumnRenamed("source", "s").join(sides(live), same(F.col("s"), F.col("source"))).groupBy("s").agg(
            F.sum(F.col("docs") * F.col("size") * w).alias("got"), F.sum(F.when(w < cap, F.col("docs") * F.col("size") * w * z).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - F.try_divide(gap, F.col("slope"))
        stepped = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        near = F.abs(gap) <= tolerance * F.col("target")
        before, after = state, (
            state.join(sums, same(F.col("source"), F.col("s")), "left").select(
                "source", "source_size", "target", "mean_size",
                F.when(F.col("got").isNull() | near, F.col("multiplier")).otherwise(stepped).alias("multiplier"),
                F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
                (F.col("got").isNull() | near).alias("done"),
            ))
        state = written(after, "mix-step", 1 if few else None)
        discard(before)
        if state.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"sources not balanced after {steps} steps")
    full = F.col("target") >= cap * F.col("source_size")
    return state.select("source", "source_size", "target", "mean_size", F.when(full, F.col("high")).otherwise(F.col("multiplier")).alias("multiplier"))


def size_copies(histogram: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """source, size, docs, copies: the copies that all documents of that size take together.

    The fold runs once per source over its distinct sizes, in chunks. n distinct sizes need n^2 / 2 words at least,
    and the longest document bounds them, so the array stays short however many documents there are.
    """
    z = F.col("size") / F.col("mean_size")
    want = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(rate(F.col("multiplier"), z, cap)) * F.col("docs") * F.col("size")
    rows = histogram.where("size > 0").withColumnRenamed("source", "s").join(solved, same(F.col("s"), F.col("source")))
    by_source = rows.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("size", "docs", want.alias("want"))), asc=False).alias("steps"), F.sum(F.col("size") * F.col("docs")).alias("words"))

    def copies(state: Column, x: Column) -> Column:
        lack = F.col("target") - state["took"]
        below = cap * (state["words"] - x["size"] * x["docs"])  # what the shorter documents can still give
        most = F.floor(lack / x["size"])
        least = F.ceil((lack - below) / x["size"])
        least = F.when((least > most) & (least * x["size"] - lack > lack - below - most * x["size"]), most).otherwise(least)
        near = F.round((state["want"] + x["want"] - state["took"]) / x["size"])
        return F.greatest(F.lit(0).cast("long"), F.least(cap * x["docs"], F.greatest(F.least(near, most), least).cast("long")))

    def step(state: Column, x: Column) -> Column:
        n = copies(state, x)
        return F.struct(
            (state["want"] + x["want"]).alias("want"), (state["took"] + n * x["size"]).alias("took"),
            (state["words"] - x["size"] * x["docs"]).alias("words"), F.concat(state["copies"], F.array(n)).alias("copies"))

    def once(x: Column, then) -> Column:
        """then(x), with x evaluated a single time."""
        return F.element_at(F.transform(F.array(x), then), 1)

    def chunk(state: Column, steps: Column) -> Column:
        start = F.struct(state["want"].alias("want"), state["took"].alias("took"), state["words"].alias("words"), F.array().cast("array<bigint>").alias("copies"))
        return once(F.aggregate(steps, start, step), lambda r: F.struct(r["want"].alias("want"), r["took"].alias("took"), r["words"].alias("words"), F.concat(state["all"], F.array(r["copies"])).alias("all")))

    start = F.struct(F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("took"), F.col("words").alias("words"), F.array().cast("array<array<bigint>>").alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / FOLDED).cast("int")), lambda i: F.slice("steps", i * FOLDED + 1, F.lit(FOLDED)))
    folded = F.flatten(F.aggregate(chunks, start, chunk)["all"])
    return by_source.select("source", F.explode(F.arrays_zip("steps", folded.alias("copies"))).alias("x")).select(
        "source", F.col("x.steps.size").alias("size"), F.col("x.steps.docs").alias("docs"), F.col("x.copies").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies): one row per row of docs.

    Null sources form a source of their own, ranked last; null and empty texts have size 0 and no copies.
    An empty table gives no rows. Rows that repeat a doc_id count as documents of their own.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.col("doc_id"), text_of()).alias("draw")), "mix-sizes")
    histogram = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-histogram")
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, cap)
    solved = solve(histogram, targets, cap)
    copies = size_copies(histogram, solved, cap)
    # Large classes (one size, one source) are ranked in parts; each part gets its share of the class's copies.
    plan = written(
        histogram.alias("h").join(copies.alias("c"), same(F.col("h.source"), F.col("c.source")) & (F.col("h.size") == F.col("c.size")), "left")
        .join(solved.alias("t"), same(F.col("h.source"), F.col("t.source")))
        .select("h.source", "h.size", "h.docs", F.coalesce("copies", F.lit(0)).alias("copies"), "source_size", "target", F.ceil(F.col("h.docs") / RANKED).cast("int").alias("parts")),
        "mix-plan")
    keyed = rows.alias("d").join(plan.alias("p"), same(F.col("d.source"), F.col("p.source")) & (F.col("d.size") == F.col("p.size"))).select(
        "doc_id", "d.source", "d.size", "draw", "docs", "copies", "source_size", "target", F.pmod(F.col("draw"), F.col("parts")).cast("int").alias("part"))
    shares = keyed.groupBy("source", "size", "part", "docs", "copies").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source", "size").orderBy("part"))
    portion = lambda n: F.floor(n * F.col("copies") / F.col("docs"))
    shares = shares.withColumn("share", portion(upto) - portion(upto - F.col("held"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("q"), "held", "share")
    ranked = keyed.join(shares, same(F.col("source"), F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("q")))
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id"))
    base = F.floor(F.col("share") / F.col("held"))
    taken = base + F.when(F.col("nth") <= F.col("share") - base * F.col("held"), 1).otherwise(0)
    return ranked.withColumn("nth", nth).select("doc_id", "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"), taken.cast("int").alias("copies"), "source", "draw")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns whatever their names.

    Documents without words (null and empty texts) stay once. Null sources are a source; rows that agree in
    doc_id, source and text share their copies evenly. An empty table gives no rows.
    """
    key = ["id", "draw", "source"]
    plan = mix(docs, weights, cap).select(F.col("doc_id").alias("id"), "draw", "source", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies"))
    plan = plan.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id"), text_of()).alias("draw"), F.col("source").cast("string").alias("source"))
    on = same(F.col("r.id"), F.col("p.id")) & (F.col("r.draw") == F.col("p.draw")) & same(F.col("r.source"), F.col("p.source"))
    joined = rows.alias("r").join(plan.alias("p"), on).select("r.*", "copies", "rows")
    alone = joined.where("rows = 1").select("row", F.col("copies").alias("times"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("rows"))
    several = joined.where("rows > 1").withColumn("nth", nth).select("row", (F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).alias("times"))
    both = alone.unionByName(several).where("times > 0")
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")
