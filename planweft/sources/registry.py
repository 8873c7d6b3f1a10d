"""Source ids and the tables behind them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from planweft.errors import PlanError, check
from planweft.plans.rels import InputSource
from planweft.types import DataType, TypeId, named

#: Types that hold a declared type's values as they are; others are cast.
BY_SPARK: dict[type, TypeId] = {
    T.BooleanType: TypeId.BOOL8, T.ByteType: TypeId.INT8, T.ShortType: TypeId.INT16, T.IntegerType: TypeId.INT32, T.LongType: TypeId.INT64,
    T.FloatType: TypeId.FLOAT32, T.DoubleType: TypeId.FLOAT64, T.StringType: TypeId.STRING, T.DateType: TypeId.TIMESTAMP_DAYS,
    T.TimestampNTZType: TypeId.TIMESTAMP_MICROSECONDS, T.TimestampType: TypeId.TIMESTAMP_MICROSECONDS, T.DayTimeIntervalType: TypeId.DURATION_MICROSECONDS, T.NullType: TypeId.EMPTY,
}


def declared(df: DataFrame, nullable: bool | None = None) -> tuple[DataType, ...]:
    """The plan schema of a DataFrame; ``nullable`` overrides what Spark says of its columns."""
    found = []
    for f in df.schema.fields:
        kind = BY_SPARK.get(type(f.dataType))
        if kind is None and isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0 and f.dataType.precision <= 20:
            kind = TypeId.UINT64
        check(kind is not None, f"column {f.name}: {f.dataType.simpleString()} has no type in the plan language")
        found.append(DataType(kind, f.nullable if nullable is None else nullable))
    return tuple(found)


class Sources:
    """A registry: DataFrames, Arrow tables, rows, or files that Spark reads, by source id."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_id: dict[int, DataFrame] = {}

    def register(self, source_id: int, data: object, schema: tuple[DataType, ...] | None = None) -> None:
        """``data``: a DataFrame, an Arrow table or record batch, a list of either (fragments), or a list of rows with ``schema``."""
        check(isinstance(source_id, int) and not isinstance(source_id, bool), f"a source id is a whole number, not {source_id!r}")
        self.by_id[source_id] = self.frame(data, schema)

    def read(self, source_id: int, path: str, format: str = "parquet", **options: object) -> None:
        """A source in files; only the columns and rows that the plan needs are read."""
        self.register(source_id, self.spark.read.format(format).options(**options).load(path))

    def frame(self, data: object, schema: tuple[DataType, ...] | None) -> DataFrame:
        import pyarrow as pa

        if isinstance(data, DataFrame):
            return data
        if isinstance(data, pa.RecordBatch):
            data = pa.Table.from_batches([data])
        if isinstance(data, pa.Table):
            return self.spark.createDataFrame(data)
        if isinstance(data, list) and data and isinstance(data[0], (pa.Table, pa.RecordBatch, DataFrame)):
            first, *others = (self.frame(x, None) for x in data)
            for x in others:
                first = first.union(x)
            return first
        if isinstance(data, list) and schema is not None:
            fields = [T.StructField(c, t.spark, True) for c, t in zip(named(schema), schema, strict=True)]
            return self.spark.createDataFrame([tuple(map(self.value, row, schema)) for row in data], T.StructType(fields))
        raise PlanError(f"{type(data).__name__} is no source")

    @staticmethod
    def value(x: object, of: DataType) -> object:
        """Rows give times as ticks too, as literals do."""
        if isinstance(x, int) and of.type_id is TypeId.TIMESTAMP_DAYS:
            return datetime.date(1970, 1, 1) + datetime.timedelta(days=x)
        if isinstance(x, int) and of.type_id is TypeId.UINT64:
            from decimal import Decimal

            return Decimal(x)
        return x

    def source(self, rel: InputSource) -> DataFrame:
        """A source's columns by position, named c0, c1, ... and of the declared types."""
        check(rel.source_id in self.by_id, f"no source {rel.source_id}")
        df = self.by_id[rel.source_id]
        check(len(df.columns) == len(rel.columns), f"source {rel.source_id} has {len(df.columns)} columns, the plan {len(rel.columns)}")
        df = df.toDF(*named(rel.columns))
        have = [f.dataType for f in df.schema.fields]
        return df.select(*(df[c] if h == t.spark else df[c].cast(t.spark).alias(c) for c, h, t in zip(df.columns, have, rel.columns, strict=True)))
