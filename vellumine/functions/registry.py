"""User code behind grants: a plugin's function is registered only with the capabilities it asks for."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: What a plugin can be granted.
CAPABILITIES = ("read-text", "read-structure", "read-outline", "read-layers", "read-attachments", "write-annotations", "read-forms", "write-forms", "log")
MANIFEST = "id string, name string, version string, world string, author string, description string, capabilities array<struct<type:string,obj_num:int>>"


def permitted(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """calls and grants: plugin, capability. Calls that a grant covers; everything else is denied."""
    return calls.join(grants.select("plugin", "capability").distinct(), ["plugin", "capability"], "left_semi")


def manifests(rows: DataFrame, world: str) -> DataFrame:
    """rows: json. Adds manifest and valid: id, name, version (three numbers at least) and the host's world."""
    m = rows.withColumn("manifest", F.from_json("json", MANIFEST))
    text = lambda c: F.coalesce(F.length(f"manifest.{c}"), F.lit(0)) > 0
    return m.withColumn("valid", text("id") & text("name") & F.coalesce(F.col("manifest.version").rlike("^[0-9]+(\\.[0-9]+){2,}$"), F.lit(False)) & F.coalesce(F.col("manifest.world") == world, F.lit(False)))


class Registry:
    """Functions over page text by plugin; grants are (plugin, capability) pairs."""

    def __init__(self, spark: SparkSession, grants: set[tuple[str, str]]):
        self.spark, self.grants = spark, grants

    def scalar(self, plugin: str, name: str, function, returns: str) -> None:
        """A function from a pandas Series of texts to one of results, callable from SQL."""
        if (plugin, "read-text") not in self.grants:
            raise PermissionError(f"{plugin} has no grant to read text")
        self.spark.udf.register(name, pandas_udf(function, returns))

    def annotate(self, plugin: str, pages: DataFrame, function) -> DataFrame:
        """Rows (doc_id, page, kind, contents) that a plugin makes of pages (doc_id, page, text)."""
        for capability in ("read-text", "write-annotations"):
            if (plugin, capability) not in self.grants:
                raise PermissionError(f"{plugin} has no grant {capability}")
        return pages.select("doc_id", "page", "text").mapInPandas(lambda batches: map(function, batches), "doc_id long, page int, kind string, contents string")
