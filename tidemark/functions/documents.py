"""Metadata documents: exact field sets, no duplicate keys, at every level."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DecimalType,
    IntegralType,
    NumericType,
    StructType,
)

from tidemark.schemas import as_struct


def _of_type(kind: Column, wanted: DataType) -> Column:
    """Is the type of a JSON value one that ``wanted`` holds without change? NULL is of every type."""
    if isinstance(wanted, BooleanType):
        allowed = "BOOLEAN"
    elif isinstance(wanted, IntegralType):
        allowed = "BIGINT"
    elif isinstance(wanted, DecimalType):
        allowed = r"BIGINT|DECIMAL\([0-9]+,0\)"
    elif isinstance(wanted, NumericType):
        allowed = r"BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)"
    else:
        allowed = "STRING"
    return F.coalesce(kind.rlike(f"^(VOID|{allowed})$"), F.lit(True))


def document_problem(
    text: Column, schema: DataType, optional: frozenset[str] = frozenset()
) -> Column:
    """First structural problem of a JSON text, NULL when it matches ``schema``.

    Checked on the text itself: parsing to a struct would drop unknown fields and
    keep only one of two equal keys.
    """
    if isinstance(schema, StructType):
        keys = F.json_object_keys(text)
        allowed = F.array(*[F.lit(f.name) for f in schema])
        required = [F.lit(f.name) for f in schema if f.name not in optional]
        check = (
            F.when(keys.isNull(), "not_object")
            .when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate_key")
            .when(F.size(F.array_except(keys, allowed)) > 0, "unknown_field")
            .when(F.size(F.array_except(F.array(*required), keys)) > 0, "missing_field")
        )
        inner = [
            document_problem(F.get_json_object(text, f"$.{f.name}"), f.dataType, optional)
            for f in schema
            if isinstance(f.dataType, (StructType, ArrayType))
        ]
        # A value that is null or absent is judged by the field set alone.
        nested = [
            F.when(F.get_json_object(text, f"$.{f.name}").isNotNull(), p)
            for f, p in zip(
                [f for f in schema if isinstance(f.dataType, (StructType, ArrayType))], inner
            )
        ]
        value = F.try_parse_json(text)
        plain = [
            F.when(~_of_type(F.schema_of_variant(F.try_variant_get(value, f"$.{f.name}", "variant")), f.dataType), "wrong_type")
            for f in schema
            if not isinstance(f.dataType, (StructType, ArrayType))
        ]
        return F.coalesce(check, *plain, *nested)
    if isinstance(schema, ArrayType) and isinstance(
        schema.elementType, (StructType, ArrayType)
    ):
        items = F.from_json(text, "array<string>")
        problems = F.transform(
            items, lambda item: document_problem(item, schema.elementType, optional)
        )
        return F.when(items.isNull(), "not_array").otherwise(
            F.get(F.filter(problems, F.isnotnull), F.lit(0))
        )
    return F.lit(None).cast("string")


def strict_json_doc(
    df: DataFrame, col: str, schema: str | StructType, optional: frozenset[str] = frozenset()
) -> DataFrame:
    """Add ``doc`` (NULL for a bad document) and ``problem`` (NULL for a good one)."""
    schema = as_struct(schema)
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    return (
        df.withColumn("problem", document_problem(F.col(col), schema, optional))
        .withColumn("doc", F.when(F.col("problem").isNull(), parsed))
    )


def differing_field(left: Column, right: Column, names: list[str]) -> Column:
    """First of the named fields in which two documents differ, NULL when they agree in all; NULL equals NULL."""
    return F.coalesce(*[F.when(~left[n].eqNullSafe(right[n]), F.lit(n)) for n in names], F.lit(None).cast("string"))
