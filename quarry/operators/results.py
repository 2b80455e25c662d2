"""Result files, resume and retry.

Result rows: id, query, answer, long_answer, short_answer, is_exact_match, is_substring_match,
status, error. Error rows carry only id, query, error and status = 'error'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("answer", T.ArrayType(T.StringType())),
    T.StructField("long_answer", T.StringType()),
    T.StructField("short_answer", T.StringType()),
    T.StructField("is_exact_match", T.IntegerType()),
    T.StructField("is_substring_match", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

_RESULT_COLS = ["long_answer", "short_answer", "is_exact_match", "is_substring_match", "status", "error"]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON lines with a fixed schema. Blank lines are skipped; a malformed line is kept in
    ``_corrupt_record`` instead of stopping the load; a missing path gives an empty table."""
    from py4j.protocol import Py4JJavaError  # noqa: F401
    try:
        return (spark.read.schema(RESULT_SCHEMA)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                .json(path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], RESULT_SCHEMA)
        raise


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per line, written as a new directory (never over the input read)."""
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The one-row summary as a single JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def last_answer_per_query(df: DataFrame, query: str = "query", answer: str = "answer",
                          seq: str = "seq") -> DataFrame:
    """A dict keyed by query text keeps the last answer written -> max_by(answer, seq)."""
    return df.groupBy(query).agg(F.max_by(answer, seq).alias(answer))


def error_rows(results: DataFrame) -> DataFrame:
    """Rows whose status is 'error'."""
    return results.filter(F.col("status") == "error")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def lookup_items(errors: DataFrame, dataset: DataFrame, key: str = "id", *, order: list[str]) -> DataFrame:
    """The dataset item of each error row, the first by ``order`` of those with its id; none ->
    stays failed."""
    return errors.select(key).join(first_by(dataset, [key], order), key, "left")


def merge_rerun(results: DataFrame, rerun: DataFrame, key: str = "id", *, order: list[str]) -> DataFrame:
    """A successful rerun row (the first by ``order``) replaces the first error row by
    ``order`` with the same id; a failed rerun leaves the original error row in place."""
    ok = first_by(rerun.filter(F.col("status") != "error"), [key], order)
    r = ok.select(key, *[F.col(c).alias(f"_r_{c}") for c in _RESULT_COLS])
    is_error = F.coalesce(F.col("status") == "error", F.lit(False))
    w = Window.partitionBy(key, is_error).orderBy(*order)
    base = results.withColumn("_first_err", is_error & (F.row_number().over(w) == 1))
    j = base.join(r, key, "left")
    take = F.col("_first_err") & F.col("_r_status").isNotNull()
    for c in _RESULT_COLS:
        j = j.withColumn(c, F.when(take, F.col(f"_r_{c}")).otherwise(F.col(c)))
    return j.drop("_first_err", *[f"_r_{c}" for c in _RESULT_COLS])


def retried_ids(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were errors before and are successes after."""
    ok = after.filter(F.col("status") != "error").select(key)
    return error_rows(before).select(key).join(ok, key, "left_semi")


def still_failing(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Former error ids not recovered."""
    ok = after.filter(F.col("status") != "error").select(key)
    return error_rows(before).select(key).join(ok, key, "left_anti")


def retry_stats(rerun: DataFrame) -> DataFrame:
    """Reprocessed count, still failing, ratios over the reprocessed successes."""
    ok = F.col("status") != "error"
    return rerun.agg(
        F.count("*").alias("reprocessed"),
        F.sum((~ok).cast("int")).cast("long").alias("still_failing"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("is_exact_match"))), F.lit(0.0)), 6).alias("exact_match"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("is_substring_match"))), F.lit(0.0)), 6).alias("substring_match"),
        F.round(F.coalesce(F.avg(F.when(ok, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("recovered_share"))


def process_safely(df: DataFrame, fn_col, out_type: str = "string") -> DataFrame:
    """Run a per-row processing pandas UDF that returns struct<value, error>; a failing row
    becomes an error value instead of failing the job."""
    return df.withColumn("_out", fn_col).select("*", F.col("_out.value").alias("value"),
                                                F.col("_out.error").alias("error")).drop("_out")


def retry(items: DataFrame, process, attempts: int = 2, key: str = "id", *, order: list[str],
          materialize=None) -> tuple[DataFrame, DataFrame]:
    """Y2: rerun only failed ids, up to ``attempts`` rounds, stop early when none is left.

    ``process``: DataFrame -> result DataFrame with ``status``. Each round's results are
    materialised (``materialize``, default: checkpoint to the shared checkpoint folder) so the
    lineage does not grow with the number of rounds. Returns (merged results, retried ids).
    """
    from quarry.session import checkpoint_dir

    if materialize is None:
        checkpoint_dir(items.sparkSession)

        def materialize(d):
            return d.checkpoint(eager=True)
    results = materialize(process(items))
    first = results
    for _ in range(attempts):
        failed = error_rows(results).select(key)
        if failed.limit(1).count() == 0:
            break
        rerun = process(items.join(failed, key, "left_semi"))
        results = materialize(merge_rerun(results, rerun, key, order=order))
    return results, retried_ids(first, results, key)
