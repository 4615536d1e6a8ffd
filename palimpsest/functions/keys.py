"""Keys that compare alike for all types: numbers before strings before null, 1 equal to 1.0, 1 unlike '1', null equal to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, TIME, OTHER, NULL = 0, 1, 2, 3, 4, 9
KEY_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("num", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("str", T.StringType())])
)


def key_part(column: Column, kind: T.DataType) -> Column:
    """One key column as a struct whose comparison is the order of keys. ``whole`` keeps integers beyond 2**53 apart, ``str`` decimals that a double can't hold; instants are whole microseconds, whatever the session's time zone."""
    num, whole, text = F.lit(0.0), F.lit(0).cast("bigint"), F.lit("")
    if isinstance(kind, T.IntegralType):
        rank, num, whole = NUMBER, column.cast("double"), column.cast("bigint")
    elif isinstance(kind, T.DecimalType):
        rank, num = NUMBER, column.cast("double")
        integral = (column == F.floor(column)) & (F.abs(num) < 9e18)
        whole = F.when(integral, column.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        exact = F.coalesce(num.try_cast(kind) == column, F.lit(False))
        text = F.when(integral | exact, "").otherwise(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"))
    elif isinstance(kind, T.TimestampType):
        rank, whole = TIME, F.unix_micros(column)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        rank, num = NUMBER, column.cast("double")
        whole = F.when((num == F.floor(num)) & (F.abs(num) < 9e18), num.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        column = F.when(F.isnan(num), F.lit(None)).otherwise(num)
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        rank, text = STRING, column
    elif isinstance(kind, T.BooleanType):
        rank, text = BOOLEAN, column.cast("string")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        rank, text = TIME, column.cast("string")
    elif isinstance(kind, T.NullType):
        rank = NULL
    else:
        rank, text = OTHER, F.to_json(F.struct(column.alias("v")))
    null = F.struct(F.lit(NULL).alias("kind"), F.lit(0.0).alias("num"), F.lit(0).cast("bigint").alias("whole"), F.lit("").alias("str"))
    return F.when(column.isNull(), null).otherwise(F.struct(F.lit(rank).alias("kind"), num.alias("num"), whole.alias("whole"), text.alias("str")))


def key_of(parts: list[tuple[Column, T.DataType]]) -> Column:
    """Key of a row from its key columns."""
    return F.array(*[key_part(c, t) for c, t in parts]).cast(KEY_TYPE)


def number_key(column: Column) -> Column:
    """Key of a row index."""
    return key_of([(column.cast("bigint"), T.LongType())])


def python_order(value) -> tuple:
    """The same order for values on the driver."""
    if value is None or value != value:
        return (NULL, 0, "")
    if isinstance(value, bool):
        return (BOOLEAN, 0, str(value).lower())
    if isinstance(value, (int, float)):
        return (NUMBER, value, "")
    if isinstance(value, str):
        return (STRING, 0, value)
    raise ValueError(f"invalid key value {value!r}")
