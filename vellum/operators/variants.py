"""Columns of JSON as VARIANT: what they hold is discovered from all rows, and flattened to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(rows: DataFrame, column: str, into: str = "v") -> DataFrame:
    """rows with the variant of a JSON column; null where it is null or no JSON."""
    return rows.withColumn(into, F.try_parse_json(F.col(f"`{column}`")))


def discover(rows: DataFrame, column: str) -> T.DataType:
    """The type that all values of a variant column have in common, by one aggregation whose states are schemas. Objects become structs, values of several types stay variants."""
    found = rows.agg(F.schema_of_variant_agg(F.col(f"`{column}`")).alias("s")).first().s
    return T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))


def flatten(rows: DataFrame, column: str, prefix: str = "", schema: T.DataType | None = None) -> DataFrame:
    """rows, with a typed column `prefix` + name for each field of the objects in a variant column; a value that is of another type is null there."""
    schema = schema or discover(rows, column)
    fields = schema.fields if isinstance(schema, T.StructType) else []
    v = F.col(f"`{column}`")

    def value(name: str, kind: str):
        if "'" not in name:
            return F.try_variant_get(v, f"$['{name}']", kind)
        return F.try_variant_get(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name)), "$", kind)

    return rows.withColumns({prefix + f.name: value(f.name, f.dataType.simpleString()) for f in fields})


def fields_of(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Per group and field of the objects in a variant column: how often it comes, with which types, and the sum of its whole numbers."""
    view = rows.select(*by, F.col(f"`{column}`").alias("_v"))
    each = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return each.groupBy(*by, "key").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.schema_of_variant("value"))), ",").alias("types"), F.sum(F.try_variant_get("value", "$", "bigint")).alias("total")
    )
