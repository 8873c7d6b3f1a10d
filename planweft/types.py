"""The plan language's types and their Spark counterparts.

Spark has no unsigned integers and no nanoseconds: unsigned types are held one
step wider (UINT64 as decimal(20,0)) and checked for range when a value is cast
to them, nanosecond types are held as their count in a long.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweft.errors import PlanError, check


class TypeId(str, Enum):
    EMPTY = "EMPTY"
    BOOL8 = "BOOL8"
    INT8 = "INT8"
    INT16 = "INT16"
    INT32 = "INT32"
    INT64 = "INT64"
    UINT8 = "UINT8"
    UINT16 = "UINT16"
    UINT32 = "UINT32"
    UINT64 = "UINT64"
    FLOAT32 = "FLOAT32"
    FLOAT64 = "FLOAT64"
    STRING = "STRING"
    TIMESTAMP_DAYS = "TIMESTAMP_DAYS"
    TIMESTAMP_SECONDS = "TIMESTAMP_SECONDS"
    TIMESTAMP_MILLISECONDS = "TIMESTAMP_MILLISECONDS"
    TIMESTAMP_MICROSECONDS = "TIMESTAMP_MICROSECONDS"
    TIMESTAMP_NANOSECONDS = "TIMESTAMP_NANOSECONDS"
    DURATION_SECONDS = "DURATION_SECONDS"
    DURATION_MILLISECONDS = "DURATION_MILLISECONDS"
    DURATION_MICROSECONDS = "DURATION_MICROSECONDS"
    DURATION_NANOSECONDS = "DURATION_NANOSECONDS"


_SPARK: dict[TypeId, T.DataType] = {
    TypeId.EMPTY: T.NullType(),
    TypeId.BOOL8: T.BooleanType(),
    TypeId.INT8: T.ByteType(),
    TypeId.INT16: T.ShortType(),
    TypeId.INT32: T.IntegerType(),
    TypeId.INT64: T.LongType(),
    TypeId.UINT8: T.ShortType(),
    TypeId.UINT16: T.IntegerType(),
    TypeId.UINT32: T.LongType(),
    TypeId.UINT64: T.DecimalType(20, 0),
    TypeId.FLOAT32: T.FloatType(),
    TypeId.FLOAT64: T.DoubleType(),
    TypeId.STRING: T.StringType(),
    TypeId.TIMESTAMP_DAYS: T.DateType(),
    TypeId.TIMESTAMP_NANOSECONDS: T.LongType(),
    TypeId.DURATION_NANOSECONDS: T.LongType(),
}
_TICKS = {"SECONDS": 1_000_000, "MILLISECONDS": 1_000, "MICROSECONDS": 1}
_UNSIGNED_BITS = {TypeId.UINT8: 8, TypeId.UINT16: 16, TypeId.UINT32: 32, TypeId.UINT64: 64}
_SIGNED_BITS = {TypeId.INT8: 8, TypeId.INT16: 16, TypeId.INT32: 32, TypeId.INT64: 64}


@dataclass(frozen=True)
class DataType:
    """A type id and whether nulls may occur. Equality includes nullability."""

    type_id: TypeId
    nullable: bool = False

    def __str__(self) -> str:
        return f"{self.type_id.value}{'?' if self.nullable else ''}"

    def as_nullable(self) -> DataType:
        return DataType(self.type_id, True)

    @property
    def spark(self) -> T.DataType:
        kind, _, unit = self.type_id.value.partition("_")
        if self.type_id in _SPARK:
            return _SPARK[self.type_id]
        return T.TimestampNTZType() if kind == "TIMESTAMP" else T.DayTimeIntervalType()

    @property
    def integral(self) -> bool:
        return self.type_id in _SIGNED_BITS or self.type_id in _UNSIGNED_BITS

    @property
    def unsigned_bits(self) -> int | None:
        return _UNSIGNED_BITS.get(self.type_id)

    @property
    def floating(self) -> bool:
        return self.type_id in (TypeId.FLOAT32, TypeId.FLOAT64)


Schema = tuple[DataType, ...]


def type_id(name: str) -> TypeId:
    check(isinstance(name, str) and name in TypeId.__members__, f"unknown type {name!r}")
    return TypeId[name]


def named(schema: Schema) -> list[str]:
    return [f"c{i}" for i in range(len(schema))]


def cast(value: Column, to: DataType) -> Column:
    """``value`` as the declared type; a value out of an unsigned type's range raises, as Spark's own casts do."""
    made = value.cast(to.spark)
    bits = to.unsigned_bits
    if bits is None:
        return made
    wide = value.cast("decimal(38,0)")
    outside = (wide < F.lit(0)) | (wide > F.lit(str(2**bits - 1)).cast("decimal(20,0)"))
    return F.when(outside, F.raise_error(F.lit(f"value out of range for {to.type_id.value}")).cast(to.spark)).otherwise(made)


def literal(value: object, of: DataType) -> Column:
    """A constant. Times are whole ticks of their unit since 1970-01-01, or of the duration."""
    if value is None:
        return F.lit(None).cast(of.spark)
    name = of.type_id.value
    if of.type_id is TypeId.TIMESTAMP_DAYS:
        return F.lit(datetime.date(1970, 1, 1) + datetime.timedelta(days=value))
    kind, _, unit = name.partition("_")
    if unit in _TICKS and kind == "TIMESTAMP":
        return F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=value * _TICKS[unit])).cast(T.TimestampNTZType())
    if unit in _TICKS and kind == "DURATION":
        return F.lit(datetime.timedelta(microseconds=value * _TICKS[unit]))
    if of.type_id is TypeId.UINT64:
        return F.lit(str(value)).cast(of.spark)
    return F.lit(value).cast(of.spark)


def checked_literal(value: object, of: TypeId) -> object:
    """The JSON value of a literal, if it fits its type."""
    if value is None:
        return None
    if of is TypeId.BOOL8:
        check(isinstance(value, bool), f"{value!r} is no BOOL8")
    elif of in (TypeId.FLOAT32, TypeId.FLOAT64):
        check(isinstance(value, (int, float)) and not isinstance(value, bool), f"{value!r} is no {of.value}")
        value = float(value)
    elif of is TypeId.STRING:
        check(isinstance(value, str), f"{value!r} is no STRING")
    elif of is TypeId.EMPTY:
        raise PlanError("an EMPTY literal can only be null")
    else:
        check(isinstance(value, int) and not isinstance(value, bool), f"{value!r} is no {of.value}")
        low, high = (0, 2 ** _UNSIGNED_BITS[of] - 1) if of in _UNSIGNED_BITS else (-(2 ** (_SIGNED_BITS.get(of, 64) - 1)), 2 ** (_SIGNED_BITS.get(of, 64) - 1) - 1)
        check(low <= value <= high, f"{value} is out of range for {of.value}")
    return value
