"""Object versions, cross-reference sections, revisions and edit histories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, revision: int | None = None) -> DataFrame:
    """versions: obj, revision, value. The highest version at or below revision, the latest without one."""
    rows = versions if revision is None else versions.where(F.col("revision") <= revision)
    return rows.groupBy("obj").agg(F.max("revision").alias("revision"), F.max_by("value", "revision").alias("value"))


def as_of_join(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """asked: obj, at. The last version at or before each asked time, null where there is none: one shuffle, one sort."""
    both = versions.select("obj", F.col("revision").alias("at"), F.lit(0).alias("asked"), F.struct("revision", "value").alias("v")).unionByName(
        asked.select("obj", "at", F.lit(1).alias("asked"), F.lit(None).cast(versions.select(F.struct("revision", "value").alias("v")).schema["v"].dataType).alias("v")))
    held = F.last("v", ignorenulls=True).over(Window.partitionBy("obj").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("v", held).where("asked = 1").select("obj", "at", "v.revision", "v.value")


def newest_wins(sections: DataFrame, strict: bool = False) -> DataFrame:
    """sections: section (0 is the newest), obj, offset, in_use. The entry of the newest section per object.

    A free entry of offset 0 doesn't hide an older live one, unless strict.
    """
    rows = sections if strict else sections.where("offset <> 0 OR in_use")
    return rows.groupBy("obj").agg(F.min_by(F.struct("section", "offset", "in_use"), "section").alias("e")).select("obj", "e.*")


def overlay(table: DataFrame, stream: DataFrame) -> DataFrame:
    """Live entries of table, else live entries of stream. Both: obj, offset, in_use."""
    t, s = table.where("in_use").select("obj", F.col("offset").alias("t")), stream.where("in_use").select("obj", F.col("offset").alias("s"))
    return t.join(s, "obj", "full_outer").select("obj", F.coalesce("t", "s").alias("offset"), F.col("t").isNotNull().alias("from_table"))


def xref_changes(before: DataFrame, after: DataFrame, level: int = 2) -> DataFrame:
    """obj, change (modified, added, deleted), allowed at a permission level: 1 nothing, 2 and 3 all but deletions."""
    b, a = before.select("obj", F.col("offset").alias("b")), after.select("obj", F.col("offset").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "obj", "full_outer").select("obj", change.alias("change")).where("change IS NOT NULL").withColumn("allowed", (F.lit(level) > 1) & (F.col("change") != "deleted"))


def offsets_moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects of before that stand elsewhere in after."""
    a = after.select(F.col("obj").alias("o"), F.col("offset").alias("f"))
    return before.join(a, (F.col("obj") == F.col("o")) & (F.col("offset") != F.col("f")), "left_semi")


def revision_history(sections: DataFrame) -> DataFrame:
    """sections: doc, number, end_offset, objects. Adds bytes: what each revision appended."""
    before = F.lag("end_offset", 1, 0).over(Window.partitionBy("doc").orderBy("number"))
    return sections.withColumn("bytes", F.col("end_offset") - before)


def runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Maximal runs of consecutive numbers per key: first, length."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.select(*keys, number).distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min(number).alias("first"), F.count(F.lit(1)).alias("length")).drop("island")


def incremental_size(dirty: DataFrame) -> DataFrame:
    """dirty: doc, bytes (lengths). Estimated bytes of an appended save: contents, rows of 20, and fixed parts."""
    return dirty.groupBy("doc").agg((F.sum("bytes") + 6 + 20 * (F.count(F.lit(1)) + 1) + 100).cast("long").alias("estimate"))


def undo_state(operations: Column) -> Column:
    """operations: array of (kind, name) in order; kinds record, undo, redo. (applied, undone); a record clears undone."""
    empty = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    short = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)

    def step(s: Column, o: Column) -> Column:
        undo, redo = (o["kind"] == "undo") & (F.size(s["applied"]) > 0), (o["kind"] == "redo") & (F.size(s["undone"]) > 0)
        record = o["kind"] == "record"
        applied = F.when(record, F.concat(s["applied"], F.array(o["name"]))).when(undo, short(s["applied"])).when(redo, F.concat(s["applied"], F.array(last(s["undone"])))).otherwise(s["applied"])
        undone = F.when(record, empty).when(undo, F.concat(s["undone"], F.array(last(s["applied"])))).when(redo, short(s["undone"])).otherwise(s["undone"])
        return F.struct(applied.alias("applied"), undone.alias("undone"))

    return F.aggregate(operations, F.struct(empty.alias("applied"), empty.alias("undone")), step)


def apply_commands(versions: DataFrame, commands: DataFrame) -> DataFrame:
    """Overlay after commands (obj, seq, value): same (obj, revision) overwrites, later commands follow in order."""
    rows = versions.select("obj", "revision", "value", F.lit(0).alias("seq")).unionByName(commands.select("obj", "revision", "value", "seq"))
    newest = F.row_number().over(Window.partitionBy("obj", "revision").orderBy(F.desc("seq")))
    return rows.withColumn("n", newest).where("n = 1").drop("n")


def undo_commands(commands: DataFrame) -> DataFrame:
    """The commands that undo a group: reversed, old and new values exchanged."""
    total = F.count(F.lit(1)).over(Window.partitionBy("group"))
    return commands.select("group", (total - 1 - F.col("ord")).alias("ord"), "obj", F.col("new").alias("old"), F.col("old").alias("new"))


def retained(accesses: DataFrame, budget: int) -> DataFrame:
    """accesses: cache, key, seq, bytes. What a least-recently-used cache of a byte budget still holds in the end."""
    last = accesses.groupBy("cache", "key").agg(F.max("seq").alias("seq"), F.max_by("bytes", "seq").alias("bytes"))
    used = F.sum("bytes").over(Window.partitionBy("cache").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("used", used).where(F.col("used") <= budget)
