"""Input tables (S1, S2, S7) and column-pruned readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import bound_batches, scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Column pruning and filters reach the scan through Catalyst."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_split(spark: SparkSession, path: str, n: int | None = None, order_by: str = "id") -> DataFrame:
    """Load a split; ``n`` keeps the first n rows by an explicit order (files carry none)."""
    df = spark.read.parquet(path)
    return take_first(df, n, order_by) if n is not None else df


def take_first(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first ``n`` rows by ``order_by``. A limit is the feature here.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps its own top n
    and only n rows per partition reach the single final task.
    """
    return df.orderBy(F.col(order_by).asc()).limit(n)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared checkpoint folder and read again: it is computed once."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_position(df: DataFrame, order_by: str, name: str = "pos", block: int = 1 << 16) -> DataFrame:
    """0-based position of every row by an explicit order of distinct numeric values; rows of a null value come first.

    No global single-task window: rows are grouped into blocks of consecutive key values, each block
    numbers its own rows, and a running sum over the block counts (one row a block) gives the offsets.
    """
    b = df.withColumn("_blk", F.floor(F.col(order_by) / block))
    size = b.groupBy("_blk").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)      # over block counts only
    offsets = size.select(F.col("_blk").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_blk").orderBy(order_by)) - 1
    joined = b.join(offsets, F.col("_blk").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, (inside + F.col("_o")).cast("long")).drop("_blk", "_of", "_o")


def attach_by_position(items: DataFrame, item_order: str, contexts: DataFrame, context_order: str) -> DataFrame:
    """Item i gets context i; unequal numbers of rows are an error, nothing is cut."""
    n, m = items.count(), contexts.count()
    if n != m:
        raise ValueError(f"positional attach needs equal lengths: {n} items, {m} contexts")
    return row_position(items, item_order).join(row_position(contexts, context_order), "pos")


def dense_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """0-based position of every row by any explicit total order.

    A range partitioning sorts the rows; each partition's rows number themselves, and a running sum
    over the partition counts gives the offsets. The sorted table is written to the shared folder, so
    both reads see the same partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"positions-{uuid.uuid4().hex}")
    mark = F.monotonically_increasing_id()
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumns({"_part": F.shiftright(mark, 33), "_n": mark.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path))
    rows = spark.read.parquet(path)
    size = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # over partition counts only
    offsets = size.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_o"))
    return rows.join(offsets, "_part").withColumn(name, F.col("_n") + F.col("_o")).drop("_part", "_n", "_o")
