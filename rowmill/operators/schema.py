"""Schema operators: inference from a sample, comparison with a saved schema, and the guard on drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions import dates, numbers
from rowmill.functions.locales import locale
from rowmill.functions.text import is_blank
from rowmill.operators.mapping import quoted
from rowmill.plans.spec import FieldMapping, SourceOptions

#: Bits of what a column's sample holds.
INTEGER, DECIMAL, DATE, STRING = 1, 2, 4, 8
Schema = list[tuple[str, str]]


class SchemaChanged(ValueError):
    """The source no longer has the schema that was saved."""


def _text_bits(c: Column, options: SourceOptions) -> Column:
    where = locale(options.culture)
    number = numbers.normal_text(c, where)
    # whole numbers of 64 bits without a decimal separator; other numbers; dates; the rest
    whole = number.isNotNull() & ~F.contains(c, F.lit(where.decimal)) & number.try_cast("bigint").isNotNull()
    date = dates.date_of(c, options.date_format, where)
    return F.when(whole, INTEGER).when(number.isNotNull(), DECIMAL).when(date.isNotNull(), DATE).otherwise(STRING)


def _bits(c: Column, kind: str, options: SourceOptions) -> Column:
    if kind == "string":
        bits = F.when(c.isNotNull() & ~is_blank(c), _text_bits(c, options))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        bits = F.when(c.isNotNull(), INTEGER)
    elif kind.startswith("decimal"):
        bits = F.when(c.isNotNull(), F.when(F.floor(c) == c, INTEGER).otherwise(DECIMAL))
    elif kind in ("double", "float"):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        bits = F.when(c.isNotNull(), F.when(~finite, STRING).when(F.rint(c) == c, INTEGER).otherwise(DECIMAL))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        bits = F.when(c.isNotNull(), DATE)
    else:
        bits = F.when(c.isNotNull(), STRING)
    return F.coalesce(bits, F.lit(0))


def infer(sample: DataFrame, options: SourceOptions = SourceOptions()) -> DataFrame:
    """(position, field, type) of each column, from all rows given, in one aggregate.

    Null and blank values say nothing; Integer with Decimal is Decimal; any other mix is String; a column that says nothing is Unknown.
    """
    found = sample.agg(*(F.bit_or(_bits(quoted(name), kind, options)).alias(f"c{i}") for i, (name, kind) in enumerate(sample.dtypes)))
    each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(name).alias("field"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("bits")) for i, name in enumerate(sample.columns)))
    kind = F.when(F.col("f.bits") == 0, "Unknown").when(F.col("f.bits") == INTEGER, "Integer").when(F.col("f.bits").isin(DECIMAL, DECIMAL | INTEGER), "Decimal").when(F.col("f.bits") == DATE, "Date").otherwise("String")
    return found.select(F.explode(each).alias("f")).select("f.position", "f.field", kind.alias("type"))


#: Catalogue types and their coarse ones.
_RELATIONAL = {T.ByteType: "Integer", T.ShortType: "Integer", T.IntegerType: "Integer", T.LongType: "Integer", T.DecimalType: "Decimal", T.FloatType: "Decimal", T.DoubleType: "Decimal", T.BooleanType: "Boolean", T.DateType: "Date", T.TimestampType: "Date", T.TimestampNTZType: "Date", T.StringType: "String", T.CharType: "String", T.VarcharType: "String"}


def relational(schema: T.StructType) -> Schema:
    """Coarse types of a table's columns; a type without one is an error."""
    out = []
    for f in schema.fields:
        if type(f.dataType) not in _RELATIONAL:
            raise ValueError(f"Column '{f.name}' has the unsupported type '{f.dataType.simpleString()}'.")
        out.append((f.name, _RELATIONAL[type(f.dataType)]))
    return out


def compare(saved: DataFrame, inspected: DataFrame, mappings: tuple[FieldMapping, ...] = ()) -> DataFrame:
    """Differences of two schemas (position, field, type): rows (change, field, saved, inspected).

    Changes are Missing, New, TypeChanged, and UnresolvedMapping for mappings (included or not) whose source is gone. Names are compared exactly.
    """
    a = saved.select(F.col("field").alias("a"), F.col("type").alias("saved"))
    b = inspected.select(F.col("field").alias("b"), F.col("type").alias("inspected"))
    both = a.join(b, F.col("a") == F.col("b"), "full")
    change = F.when(F.col("b").isNull(), "Missing").when(F.col("a").isNull(), "New").when(F.col("saved") != F.col("inspected"), "TypeChanged")
    out = both.select(change.alias("change"), F.coalesce("a", "b").alias("field"), "saved", "inspected").where("change is not null")
    if mappings:
        spark = saved.sparkSession
        wanted = spark.createDataFrame([(m.source, m.target) for m in mappings], "source string, target string")
        lost = wanted.join(b, F.col("source") == F.col("b"), "left_anti")
        out = out.union(lost.select(F.lit("UnresolvedMapping"), F.concat("source", F.lit(" -> "), "target"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return out


def guard(saved: Schema, inspected: Schema, mappings: tuple[FieldMapping, ...] = ()) -> None:
    """SchemaChanged if anything differs, before a plan is built."""
    a, b = dict(saved), dict(inspected)
    changes = [f"missing field '{n}'" for n in a if n not in b] + [f"new field '{n}'" for n in b if n not in a]
    changes += [f"field '{n}' changed from {a[n]} to {b[n]}" for n in a if n in b and a[n] != b[n]]
    changes += [f"unresolved mapping '{m.source}' -> '{m.target}'" for m in mappings if m.source not in b]
    if changes:
        raise SchemaChanged("The source schema has changed: " + "; ".join(changes) + ".")


def document_kinds(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(field, kinds) of the top-level fields of JSON documents (a VARIANT column), kinds as a sorted list of what values are."""
    each = docs.sparkSession.sql("SELECT v.key AS field, schema_of_variant(v.value) AS kind FROM {docs}, LATERAL variant_explode(doc) AS v", docs=docs.select(F.col(column).alias("doc")))
    return each.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def document_schema(docs: DataFrame, column: str = "doc", strict: bool = False) -> DataFrame:
    """(field, type) of JSON documents: null says nothing, Integer with Decimal is Decimal; other mixes and nested values give type Error.

    strict: a field of type Error, or with a blank name, fails the read.
    """
    per = document_kinds(docs, column)
    number = F.exists("kinds", lambda k: k.isin("BIGINT"))
    decimal = F.exists("kinds", lambda k: k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"))
    names = reduce(
        lambda a, b: F.array_union(a, b),
        [
            F.when(decimal, F.array(F.lit("Decimal"))).when(number, F.array(F.lit("Integer"))).otherwise(F.array().cast("array<string>")),
            F.when(F.exists("kinds", lambda k: k == "STRING"), F.array(F.lit("String"))).otherwise(F.array().cast("array<string>")),
            F.when(F.exists("kinds", lambda k: k == "BOOLEAN"), F.array(F.lit("Boolean"))).otherwise(F.array().cast("array<string>")),
            F.when(F.exists("kinds", lambda k: k.startswith("OBJECT") | k.startswith("ARRAY")), F.array(F.lit("Nested"), F.lit("Nested2"))).otherwise(F.array().cast("array<string>")),
        ],
    )
    kind = F.when(F.size(names) > 1, "Error").when(F.size(names) == 0, "Unknown").otherwise(names[0])
    if strict:
        conflict = F.concat(F.lit("The field '"), F.col("field"), F.lit("' holds values that have no type in common: "), F.concat_ws(", ", "kinds"), F.lit("."))
        kind = F.when(is_blank(F.col("field")), F.raise_error(F.lit("A document has a field with a blank name."))).when(F.size(names) > 1, F.raise_error(conflict)).otherwise(kind)
    return per.select("field", kind.alias("type"))
