"""One table written by several versions of its schema: columns that came later, and types that grew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType,
)

#: A type reads every type before it in its chain.
CHAINS = ((ByteType(), ShortType(), IntegerType(), LongType()), (FloatType(), DoubleType()), (ByteType(), ShortType(), IntegerType(), DoubleType()))


def wider(a: DataType, b: DataType) -> DataType:
    """The type that holds the values of both without loss."""
    if a == b:
        return a
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged([a, b])
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
        if whole + scale <= 38:
            return DecimalType(whole + scale, scale)
    for chain in CHAINS:
        if a in chain and b in chain:
            return chain[max(chain.index(a), chain.index(b))]
    raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def merged(schemas: list[StructType], defaults: dict[str, str] | None = None) -> StructType:
    """Columns in the order in which they first came, each of the widest type it had.

    ``defaults`` are SQL literals of columns for versions that do not have them; without one such rows hold NULL.
    """
    types: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    given = defaults or {}
    if unknown := set(given) - set(types):
        raise ValueError(f"defaults for columns that no version has: {sorted(unknown)}")

    def field(name: str, kind: DataType) -> StructField:
        return StructField(name, kind, True, {"CURRENT_DEFAULT": given[name], "EXISTS_DEFAULT": given[name]} if name in given else None)

    return StructType([field(name, kind) for name, kind in types.items()])


def read_versions(spark: SparkSession, folders: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """All versions of a Parquet table, oldest first, as one scan under the merged schema.

    Only the footers are read to find it. Filters and columns reach the scan as for any table.
    """
    schema = merged([spark.read.parquet(folder).schema for folder in folders], defaults)
    return spark.read.schema(schema).parquet(*folders)
