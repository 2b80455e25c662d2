import pyarrow as pa

from quarry.session import BATCH_ROWS, bound_batches


def test_arrow_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        bound_batches(spark)
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"]) for b in bs), "id long").collect()
        assert max(r.id for r in sizes) <= BATCH_ROWS
        spark.conf.set(key, "7")
        bound_batches(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
