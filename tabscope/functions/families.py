"""Column classification by Spark DataType class.

Families decide which metrics a column gets:

* ``numeric``  - min/max (as double), mean, stddev, quartiles, outliers
* ``string``   - min/max (as string), regex scores
* ``temporal`` - min/max as ISO strings, only with ``extended_types``
* ``nested`` / ``other`` - null count and distinct count only

Byte and short integers are ``other`` unless ``extended_types`` is set.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
STRING = "string"
TEMPORAL = "temporal"
NESTED = "nested"
OTHER = "other"

_CORE_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.DecimalType)
_SMALL_INT = (T.ByteType, T.ShortType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def type_family(dt: T.DataType, extended: bool = False) -> str:
    if isinstance(dt, _CORE_NUMERIC):
        return NUMERIC
    if isinstance(dt, _SMALL_INT):
        return NUMERIC if extended else OTHER
    if isinstance(dt, T.StringType):
        return STRING
    if isinstance(dt, _TEMPORAL):
        return TEMPORAL
    if isinstance(dt, _NESTED):
        return NESTED
    return OTHER


def _contains_unhashable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or type(dt).__name__ == "VariantType":
        return True
    if isinstance(dt, T.ArrayType):
        return _contains_unhashable(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_contains_unhashable(f.dataType) for f in dt.fields)
    return False


def quote(name: str) -> str:
    """Backtick-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a profiled table: position, name, type and family."""

    ordinal: int  # 1-based position in the table
    name: str
    dtype: T.DataType
    nullable: bool
    family: str
    extended: bool = False

    @property
    def col(self) -> Column:
        return F.col(quote(self.name))

    @property
    def spark_type(self) -> str:
        return self.dtype.simpleString()

    @property
    def is_numeric(self) -> bool:
        return self.family == NUMERIC

    @property
    def is_string(self) -> bool:
        return self.family == STRING

    @property
    def minmax_kind(self) -> str | None:
        """``num`` -> min_num/max_num, ``str`` -> min_str/max_str, None -> no extremes."""
        if self.family == NUMERIC:
            return "num"
        if self.family == STRING or (self.family == TEMPORAL and self.extended):
            return "str"
        return None

    @property
    def distinct_capable(self) -> bool:
        return not _contains_unhashable(self.dtype)

    @property
    def sql_number(self) -> str:
        """The value as a double, in SQL; NaN is null."""
        x = f"CAST({quote(self.name)} AS DOUBLE)"
        return f"nanvl({x}, CAST(NULL AS DOUBLE))" if isinstance(self.dtype, (T.FloatType, T.DoubleType)) else x

    @property
    def reference_numeric(self) -> bool:
        """Numeric in the sense used for foreign-key type compatibility."""
        return isinstance(self.dtype, _CORE_NUMERIC) or (
            self.extended and isinstance(self.dtype, _SMALL_INT)
        )

    @property
    def is_integral(self) -> bool:
        return isinstance(self.dtype, (T.IntegerType, T.LongType, T.ByteType, T.ShortType))


def column_specs(schema: T.StructType, extended: bool = False) -> list[ColumnSpec]:
    return [
        ColumnSpec(i + 1, f.name, f.dataType, f.nullable, type_family(f.dataType, extended), extended)
        for i, f in enumerate(schema.fields)
    ]
