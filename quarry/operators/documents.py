"""Rows as documents: text with a metadata map (P1), long-form questions with contexts by position (P2), uploaded files
(S11, S12) and training files (S8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.tables import dense_position

PDF = "application/pdf"
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
#: Leading bytes (hex) of the file types that are told apart, and what to take a name's ending for.
LEADING = {"255044462D": PDF, "89504E47": "image/png", "FFD8FF": "image/jpeg", "504B0304": "application/zip"}
ENDINGS = {"pdf": PDF, "png": "image/png", "jpg": "image/jpeg", "zip": "application/zip"}
UNKNOWN = "application/octet-stream"


def _shown(df: DataFrame, field: str) -> Column:
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return F.array_join(F.transform(F.col(field), lambda x: x.cast("string")), ",", "None")
    return F.col(field).cast("string")


def to_documents(df: DataFrame, text_field: str, metadata_fields: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., text, metadata): the text field, and a map of the named fields as strings.

    A list's values are joined by commas (a null in it shows as None), any other value is taken as it is. Fields that the table does not
    have, and the text field itself, are skipped; so is a null value. A field named twice counts once.
    """
    fields = [f for f in dict.fromkeys(metadata_fields) if f in df.columns and f != text_field]
    entries = [F.struct(F.lit(f).alias("key"), _shown(df, f).alias("value")) for f in fields]
    metadata = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries \
        else F.create_map().cast("map<string,string>")
    return df.select(*keep, F.col(text_field).alias("text"), metadata.alias("metadata"))


def reshape_longform(items: DataFrame, item_order: Sequence[str], contexts: DataFrame, context_order: Sequence[str], *,
                     question: str = "question", context: str = "context", titles: str = "context_titles") -> DataFrame:
    """(query_id, query, context, context_titles): item i, as ``eli5_i``, with context i and its titles.

    Both orders have to be total. Unequal numbers of rows are an error; nothing is cut.
    """
    n, m = items.count(), contexts.count()
    if n != m:
        raise ValueError(f"positional attach needs equal lengths: {n} items, {m} contexts")
    left = dense_position(items.select(F.col(question).alias("query"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(item_order)]),
                          *[f"_o{i}" for i in range(len(item_order))])
    right = dense_position(contexts.select(F.col(context).alias("context"), F.col(titles).alias("context_titles"),
                                           *[F.col(c).alias(f"_o{i}") for i, c in enumerate(context_order)]), *[f"_o{i}" for i in range(len(context_order))])
    return (left.select("pos", "query").join(right.select("pos", "context", "context_titles"), "pos")
            .select(F.concat(F.lit("eli5_"), F.col("pos").cast("string")).alias("query_id"), "query", "context", "context_titles"))


def read_uploads(spark: SparkSession, path: str, owner: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """A row a file: path, size, file_type, accepted, reject_reason, metadata, content (of accepted files).

    Files above ``max_bytes`` are told by the source's own length and their content is never read; their type is taken from the
    name. Of the others it is told by the leading bytes. Only PDF is accepted; the type is judged first.
    An empty file has no row, as the source skips it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    by_name = F.coalesce(*[F.when(ending == e, F.lit(t)) for e, t in ENDINGS.items()], F.lit(UNKNOWN))
    head = F.hex(F.substring("content", 1, 8))
    by_bytes = F.coalesce(*[F.when(head.startswith(b), F.lit(t)) for b, t in LEADING.items()], F.lit(UNKNOWN))
    large = files.where(F.col("length") > max_bytes).select("path", "length", by_name.alias("file_type"), F.lit(None).cast("binary").alias("content"))
    small = files.where(F.col("length") <= max_bytes).select("path", "length", by_bytes.alias("file_type"), "content")
    both = large.union(small)
    reason = F.when(F.col("file_type") != PDF, F.lit("only PDF files are allowed")).when(F.col("length") > max_bytes, F.lit("file too large"))
    metadata = F.create_map(F.lit("file_name"), name, F.lit("file_type"), F.col("file_type"), F.lit("size"), F.col("length").cast("string"),
                            F.lit("user_email"), F.lit(owner))
    return both.select("path", F.col("length").alias("size"), "file_type", reason.isNull().alias("accepted"), reason.alias("reject_reason"),
                       metadata.alias("metadata"), F.when(reason.isNull(), F.col("content")).alias("content"))


def write_splits(parts: dict[str, DataFrame], path: str) -> None:
    """JSON lines in ``path``/split=name for every part, by one job: its commit shows all files or none.

    All parts have the same columns. An existing path is an error.
    """
    out = None
    for name, part in parts.items():
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        out.write.partitionBy("split").json(path)


def read_split_files(spark: SparkSession, path: str, schema: T.StructType | str, split: str | None = None) -> DataFrame:
    """The rows that :func:`write_splits` wrote; of one split only its folder is read."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).json(path)
    return rows if split is None else rows.where(F.col("split") == split)
