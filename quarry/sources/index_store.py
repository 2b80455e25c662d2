"""Vector collections on parquet.

Layout: ``<root>/collection=<name>/part-*.parquet`` with (vec_id, parent_id, embedding). A
collection is loaded with a partition filter, so only its directory is listed and read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_COLLECTION = "default"


def save_index(vectors: DataFrame, root: str, collection: str | None = None) -> None:
    """Persist vectors under a named collection (dynamic partition overwrite: other
    collections stay untouched)."""
    df = vectors if collection is None else vectors.withColumn("collection", F.lit(collection))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("collection").parquet(root))


def load_index(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """One collection, pruned to its partition; a missing index raises (Q13)."""
    return spark.read.parquet(root).filter(F.col("collection") == collection)


def register(registry: DataFrame | None, names: DataFrame) -> DataFrame:
    """Add collections (name, owner) to the registry; re-registering is a no-op."""
    if registry is None:
        return names.dropDuplicates(["collection"])
    return registry.unionByName(names.join(registry.select("collection"), "collection", "left_anti")).dropDuplicates(["collection"])


def drop(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Remove collections from the registry (left_anti)."""
    return registry.join(names.select("collection"), "collection", "left_anti")


def resolve_collection(requests: DataFrame, registry: DataFrame, requested: str = "requested",
                       default: str = DEFAULT_COLLECTION) -> DataFrame:
    """The requested collection when registered, else the default one. Catalyst picks the
    join by the registry's size."""
    reg = registry.select(F.col("collection").alias("_reg")).distinct()
    j = requests.join(reg, F.col(requested) == F.col("_reg"), "left")
    return j.withColumn("collection", F.coalesce(F.col("_reg"), F.lit(default))).drop("_reg")
