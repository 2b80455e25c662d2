"""An index that micro-batches append to through a commit log.

Layout below the root: ``data/<attempt>/collection=<name>/part-*`` holds rows, ``log/<stream>-<epoch>/`` one manifest
row for each data file: its path, collection, rows, smallest and largest key, and a Bloom filter of its keys. The log
folder's ``_SUCCESS`` marker is the commit: readers see the files of committed epochs only. A batch that was killed between
append and commit leaves data that no log names; its replay writes anew. A batch replayed after its commit is known by
its stream and epoch and skipped.

Keys that the index already holds are found by the log first: the filters of each file are asked for the batch's keys (in
blocks of ``BLOCK`` keys, so what is sent to the executors is bounded), and only files that may hold one are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a data file: bounds the keys that one task turns into a filter.
FILE_ROWS = 1 << 20
#: Bits a key and probes of a filter: about one file in a hundred is read in vain.
BITS, PROBES = 10, 7
#: Keys of a batch that are sent to the executors at once (8 bytes each).
BLOCK = 1 << 22

_LOG = "file string, collection string, n_rows long, low long, high long, filter binary"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, a row a probe (double hashing of two halves)."""
    h = hashes.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((one + np.arange(PROBES, dtype=np.uint64)[:, None] * two) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS // 64) * 64)
    out = np.zeros(bits, bool)
    out[_places(hashes, bits)] = True
    return np.packbits(out).tobytes()


def may_hold(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(filter_bytes, np.uint8)).astype(bool)
    return held[_places(hashes, len(held))].all(axis=0)


def stream_name(checkpoint: str) -> str:
    """Epochs count within one checkpoint, so that its folder names the stream."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def committed(spark: SparkSession, root: str) -> list[str]:
    """Log folders with a commit marker, by name."""
    fs, p = _fs(spark, f"{root}/log")
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
    return sorted(x.toString() for x in done)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """file, collection, n_rows, low, high, filter of every committed data file."""
    logs = committed(spark, root)
    return spark.read.schema(_LOG).parquet(*logs) if logs else spark.createDataFrame([], _LOG)


def read_committed(spark: SparkSession, root: str, schema, collection: str | None = None) -> DataFrame:
    """Rows of the committed files, of one collection or of all. Its files are picked by the log, before any is opened."""
    files = manifest(spark, root)
    if collection is not None:
        files = files.where(F.col("collection") == collection)
    names = [r.file for r in files.select("file").collect()]                  # one name a file, as a listing has
    return _read(spark, root, names, schema)


def _decoded(path):
    """%XX written out; a plus stays a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _read(spark: SparkSession, root: str, names: list[str], schema) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names])
    part = F.regexp_extract(_decoded(F.col("_metadata.file_path")), r"collection=([^/]*)/", 1)      # on disk, where / and others are %XX
    return rows.withColumn("collection", _decoded(part)).select([f.name for f in schema])


def files_to_read(spark: SparkSession, root: str, keys: DataFrame, key: str) -> list[str]:
    """Committed files that may hold one of the keys: their range and filter are asked on the executors."""
    logs = manifest(spark, root)
    hashed = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").select("k", F.xxhash64("k").alias("h"))
    found: set[str] = set()
    for block in _blocks(hashed):
        sent = spark.sparkContext.broadcast(block)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, h = sent.value
            for b in batches:
                hit = []
                for name, low, high, bits in zip(*(b.column(c).to_pylist() for c in ("file", "low", "high", "filter"))):
                    a, z = np.searchsorted(k, low), np.searchsorted(k, high, side="right")
                    if z > a and may_hold(bits, h[a:z]).any():
                        hit.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], ["file"])
        found |= {r.file for r in logs.select("file", "low", "high", "filter").mapInArrow(ask, "file string").collect()}
        sent.destroy()
    return sorted(found)


def _blocks(hashed: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and hashes of a batch in blocks of bounded size, each sorted by key."""
    k, h = [], []
    for row in hashed.toLocalIterator(prefetchPartitions=True):
        k.append(row.k)
        h.append(row.h)
        if len(k) == BLOCK:
            yield _sorted(k, h)
            k, h = [], []
    if k:
        yield _sorted(k, h)


def _sorted(k: list[int], h: list[int]) -> tuple[np.ndarray, np.ndarray]:
    k, h = np.array(k, np.int64), np.array(h, np.int64)
    order = np.argsort(k, kind="stable")
    return k[order], h[order]


def append(batch: DataFrame, root: str, stream: str, epoch: int, key: str) -> dict[str, int]:
    """Add the batch's rows whose key the index doesn't hold, and commit them under the stream's epoch.

    ``batch`` has a ``collection`` column and a whole-number key; of rows that repeat a key one stays, rows of a null key all
    stay. Returns the number of files read to find known keys and of files written; an epoch that is
    committed already is left alone.
    """
    spark = batch.sparkSession
    log = f"{root}/log/{stream}-{epoch:09d}"
    fs, p = _fs(spark, log)
    if fs.exists(p.suffix("/_SUCCESS")):
        return {"read": 0, "written": 0}
    attempt = f"data/{stream}-{epoch:09d}-{uuid.uuid4().hex[:8]}"
    batch = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.where(F.col(key).isNull()))
    names = files_to_read(spark, root, batch, key)
    if names:
        batch = batch.join(_read(spark, root, names, batch.schema).select(key), key, "left_anti")
    batch.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("collection").parquet(f"{root}/{attempt}")
    written = _describe(spark, root, attempt, key)
    written.write.mode("overwrite").parquet(log)
    return {"read": len(names), "written": spark.read.parquet(log).count()}


def _describe(spark: SparkSession, root: str, attempt: str, key: str) -> DataFrame:
    """Manifest rows of the files that an attempt wrote: one task a file, which ``FILE_ROWS`` bounds."""
    fs, p = _fs(spark, f"{root}/{attempt}")
    if not any(s.isDirectory() for s in fs.listStatus(p)):
        return spark.createDataFrame([], _LOG)
    path = _decoded(F.col("_metadata.file_path"))
    rows = spark.read.parquet(f"{root}/{attempt}").select(
        F.concat(F.lit(attempt), F.regexp_extract(path, attempt.rsplit("/", 1)[1] + "(/.*)$", 1)).alias("file"),
        F.col("collection").cast("string").alias("collection"), F.col(key).cast("long").alias("k"))
    rows = rows.withColumn("h", F.xxhash64("k"))

    def one(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("k").is_valid())
        h, k = known.column("h").to_numpy(), known.column("k").to_numpy()
        return pa.table({"file": table.column("file")[:1], "collection": table.column("collection")[:1], "n_rows": pa.array([table.num_rows], pa.int64()),
                         "low": pa.array([int(k.min()) if len(k) else 0], pa.int64()), "high": pa.array([int(k.max()) if len(k) else -1], pa.int64()),
                         "filter": pa.array([bloom(h)], pa.binary())})
    return rows.groupBy("file").applyInArrow(one, _LOG)
