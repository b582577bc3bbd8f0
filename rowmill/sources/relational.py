"""Relational tables over JDBC, in key order, split by key ranges."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.sources.order import with_row_numbers


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def _from(key: list[str], bound: tuple) -> str:
    """Whether a row's key is that of the bound or behind it, column by column."""
    parts = []
    for i, (column, value) in enumerate(zip(key, bound)):
        same = [f"{c} = {_literal(v)}" for c, v in zip(key[:i], bound)]
        parts.append("(" + " AND ".join([*same, f"{column} {'>=' if i == len(key) - 1 else '>'} {_literal(value)}"]) + ")")
    return "(" + " OR ".join(parts) + ")"


@dataclass(frozen=True)
class Ranges:
    """Key ranges of about as many rows each: where they begin, how many rows stand before each, and whether keys have nulls."""

    key: tuple[str, ...]
    bounds: tuple[tuple, ...]
    before: tuple[int, ...]
    nulls: int

    def predicates(self) -> list[str]:
        filled = " AND ".join(f"{c} IS NOT NULL" for c in self.key)
        nulls = " OR ".join(f"{c} IS NULL" for c in self.key)
        starts = [_from(list(self.key), b) for b in self.bounds]
        middle = [f"{filled} AND {a} AND NOT {b}" for a, b in zip(starts, starts[1:])]
        return [f"{filled} AND NOT {starts[0]}", *middle, f"({filled} AND {starts[-1]}) OR {nulls}"] if starts else []


def ranges_of(spark: SparkSession, url: str, table: str, key: list[str], properties: dict[str, str] | None = None, partitions: int = 16) -> Ranges:
    """The ranges of a key, by two queries whatever their number: one counts, one picks the keys at every n-th place."""
    props, names = properties or {}, ", ".join(key)
    filled = " AND ".join(f"{c} IS NOT NULL" for c in key)
    counts = spark.read.jdbc(url, f"(SELECT COUNT(*) AS n, SUM(CASE WHEN {filled} THEN 1 ELSE 0 END) AS f FROM {table}) c", properties=props).first()
    rows, whole = int(counts[0]), int(counts[1] or 0)
    step = -(-whole // partitions)
    if step == 0 or step >= whole:
        return Ranges(tuple(key), (), (), rows - whole)
    numbered = f"SELECT ROW_NUMBER() OVER () AS n_, s_.* FROM (SELECT {names} FROM {table} WHERE {filled} ORDER BY {names}) s_"
    found = spark.read.jdbc(url, f"(SELECT * FROM ({numbered}) r_ WHERE MOD(n_ - 1, {step}) = 0 AND n_ > 1) b_", properties=props).collect()
    places: dict[tuple, int] = {}
    for r in sorted(found, key=lambda r: r[0]):
        places.setdefault(tuple(r[1:]), int(r[0]) - 1)
    return Ranges(tuple(key), tuple(places), tuple(places.values()), rows - whole)


def read_table(spark: SparkSession, url: str, table: str, key: str | list[str], properties: dict[str, str] | None = None, partitions: int = 16) -> DataFrame:
    """A table, read in ranges of about as many rows each of its key, which may be text or several columns; the key is the source order.

    Column pruning and filters reach the database. The ranges take two queries; rows with a null in
    the key are in the last range. Names are spelled as in SQL.
    """
    ranges = ranges_of(spark, url, table, [key] if isinstance(key, str) else list(key), properties, partitions).predicates()
    props = properties or {}
    return spark.read.jdbc(url, table, predicates=ranges, properties=props) if ranges else spark.read.jdbc(url, table, properties=props)


def read_numbered(spark: SparkSession, url: str, table: str, key: str | list[str], properties: dict[str, str] | None = None, partitions: int = 16) -> DataFrame:
    """The same with _row_number, from 1 in the order of the key, which must be unique.

    The places of the ranges are known, so each range numbers its own rows behind those before it and nothing is written. Text keys, whose order in the
    database may be another than Spark's, and keys with nulls are numbered by a sort of all rows.
    """
    names = [key] if isinstance(key, str) else list(key)
    ranges = ranges_of(spark, url, table, names, properties, partitions)
    props = properties or {}
    plain = spark.read.jdbc(url, table, predicates=ranges.predicates(), properties=props) if ranges.bounds else spark.read.jdbc(url, table, properties=props)
    if ranges.nulls or any(isinstance(plain.schema[n].dataType, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)) for n in names):
        return with_row_numbers(plain, names)
    before = F.element_at(F.array(*(F.lit(n).cast("long") for n in (0, *ranges.before))), F.spark_partition_id() + 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return plain.sortWithinPartitions(*names).withColumn("_row_number", before + place + 1)
