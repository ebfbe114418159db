"""Scans of the raw document tables.

A source is either a path (parquet by default, JSON for document dumps) or a
catalog table name.  Scans stay lazy: column pruning and pushed filters of
whatever follows reach the file reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    DoubleType,
    NullType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

from ..session import scratch_path


def _is_path(source: str) -> bool:
    return "/" in source or "://" in source or source.endswith((".parquet", ".json"))


def read_table(
    spark: SparkSession,
    source: str,
    fmt: str | None = None,
    schema: StructType | str | None = None,
    once: bool = False,
    **options,
) -> DataFrame:
    """Read ``source`` as a path (format from ``fmt`` or the extension) or as a
    catalog table name.  A given ``schema`` skips inference (one pass less
    over the files); ``once`` infers in the pass that reads (``read_json_once``)."""
    if not _is_path(source):
        return spark.table(source)
    if fmt is None:
        fmt = "json" if source.rstrip("/").endswith(".json") else "parquet"
    if once and fmt == "json" and schema is None:
        return read_json_once(spark, source)
    reader = spark.read.options(**options).format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(source)


def _column_type(kind: DataType) -> DataType:
    """What the JSON reader infers for a kind of variant."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _column_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_column_type(kind.elementType))
    if isinstance(kind, (NullType, VariantType)):  # nothing but nulls, or of several kinds
        return StringType()
    if isinstance(kind, DecimalType) and (kind.scale or kind.precision <= 18):  # a whole number would be a long
        return DoubleType()
    return kind


def _ddl(kind: DataType) -> str:
    """The type as SQL, whatever the names of its fields."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    return kind.simpleString()


def read_json_once(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """JSON documents with inferred types, every file read and parsed once.

    The JSON reader infers in one pass and reads in another, which takes less
    processor time; read once where the files are slow or costly to read, as in an
    export from a store that bills by what is read.  Here one pass parses
    the documents into variants on the shared scratch folder, and an aggregate
    observed in it merges their shapes; the columns are then taken out of the
    variants, only those that are asked for.  The types are the JSON reader's:
    numbers with a fraction are doubles, fields of several kinds or without a value
    are strings, and a document that lacks a field has a NULL there.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("singleVariantColumn", "doc").json(paths)
    seen, path = Observation(), scratch_path(spark, "documents")
    raw.observe(seen, F.schema_of_variant_agg("doc").alias("shape")).write.parquet(path)
    shape = seen.get["shape"] or "VOID"
    if shape == "VOID":
        return spark.createDataFrame([], StructType())
    found = DataType.fromDDL(shape.replace("OBJECT<", "STRUCT<"))
    if not isinstance(found, StructType):
        raise ValueError(f"not all documents are objects: {shape}")
    docs = spark.read.schema("doc variant").parquet(path)
    columns = []
    for f in _column_type(found).fields:
        if "'" in f.name:  # no path can name it
            column = F.variant_get("doc", "$", _ddl(StructType([f]))).getField(f.name)
        else:
            column = F.variant_get("doc", f"$['{f.name}']", _ddl(f.dataType))
        columns.append(column.alias(f.name))
    return docs.select(*columns)


def read_activity(
    spark: SparkSession, source: str, fmt: str | None = None, schema=None, once: bool = False
) -> DataFrame:
    """Raw activity documents."""
    return read_table(spark, source, fmt, schema, once)


def read_entity(
    spark: SparkSession, source: str, fmt: str | None = None, schema=None, once: bool = False
) -> DataFrame:
    """Raw entity (organisation) documents."""
    return read_table(spark, source, fmt, schema, once)


def read_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "json",
    sampling_ratio: float = 1.0,
    once: bool = False,
) -> DataFrame:
    """S3: full re-inference of a document set whose records differ in fields.

    JSON: every record is sampled (``samplingRatio=1.0``, like a crawler that
    re-reads everything) and the field sets are merged into one schema; fields
    absent from a record read as NULL; ``once`` does it in one pass
    (``read_json_once``).  Parquet: footers are merged with ``mergeSchema``.
    Inference is a distributed Spark job over the files, not a driver-side pass; on
    very large inputs lower ``sampling_ratio`` or pass the schema to ``read_table``
    instead.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if once and fmt == "json":
        return read_json_once(spark, paths)
    if fmt == "json":
        reader = reader.option("samplingRatio", sampling_ratio)
    elif fmt == "parquet":
        reader = reader.option("mergeSchema", "true")
    return reader.format(fmt).load(paths)


def read_rules(spark: SparkSession, source: str, fmt: str | None = None) -> DataFrame:
    """S4 + P7: the row-level rules table as ``(UserArn, tenantid)``.

    Document stores expose attribute names lower-cased (``userarn``); the rule
    key is renamed back to ``UserArn`` and the two rule columns projected.
    """
    df = read_table(spark, source, fmt)
    return project_rules(df)


def project_rules(df: DataFrame) -> DataFrame:
    by_lower = {c.lower(): c for c in df.columns}
    missing = [c for c in ("userarn", "tenantid") if c not in by_lower]
    if missing:
        raise ValueError(f"rules table lacks {missing}")
    return df.select(
        F.col(f"`{by_lower['userarn']}`").cast("string").alias("UserArn"),
        F.col(f"`{by_lower['tenantid']}`").cast("string").alias("tenantid"),
    )
