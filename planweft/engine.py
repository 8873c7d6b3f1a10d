"""The facade: sources, options, compile, explain, and results as DataFrames, Arrow tables or slices."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from planweft.errors import PlanError, check
from planweft.functions.scalar import Generic
from planweft.operators.compiler import Compiler
from planweft.plans import codec
from planweft.plans.explain import tree
from planweft.plans.rels import Rel
from planweft.plans.validate import validate
from planweft.sources.registry import Sources
from planweft.types import DataType

if TYPE_CHECKING:
    import pyarrow as pa

#: Allocators that the plan language's hosts may name. Spark manages memory itself, so the choice has no effect.
MEMORY_RESOURCES = ("ARENA", "ARENA_PER_THREAD", "POOL", "POOL_PER_THREAD", "MANAGED", "CUDA")


@dataclass
class Options:
    """Only the bucket options change what runs; the others are accepted and checked."""

    memory_resource: int = 0
    exclusive_default_memory_resource: bool = False
    memory_resource_size: int | None = None
    memory_resource_size_per_thread: int | None = None
    threads_per_pipeline: int = 1
    bucket_aggregate: bool = False
    bucket_aggregate_buckets: int = 64


class Engine:
    def __init__(self, spark: SparkSession, strict: bool = True, generic: Generic | None = None):
        """``generic``: (Column, Column) -> Column, what GENERIC_BINARY does here."""
        self.spark, self.strict, self.generic = spark, strict, generic
        self.sources, self.options = Sources(spark), Options()

    # --- options

    def set_memory_resource(self, resource: int) -> None:
        check(0 <= resource < len(MEMORY_RESOURCES), f"unknown memory resource {resource}")
        self.options.memory_resource = resource

    def set_exclusive_default_memory_resource(self, exclusive: bool) -> None:
        self.options.exclusive_default_memory_resource = bool(exclusive)

    def _positive(self, name: str, value: int) -> None:
        check(isinstance(value, int) and value > 0, f"{name} must be positive")
        setattr(self.options, name, value)

    def set_memory_resource_size(self, size: int) -> None:
        self._positive("memory_resource_size", size)

    def set_memory_resource_size_per_thread(self, size: int) -> None:
        self._positive("memory_resource_size_per_thread", size)

    def set_threads_per_pipeline(self, threads: int) -> None:
        self._positive("threads_per_pipeline", threads)

    def set_bucket_aggregate(self, enable: bool) -> None:
        self.options.bucket_aggregate = bool(enable)

    def set_bucket_aggregate_buckets(self, buckets: int) -> None:
        self._positive("bucket_aggregate_buckets", buckets)

    # --- sources

    def register(self, source_id: int, data: object, schema: tuple[DataType, ...] | None = None) -> None:
        self.sources.register(source_id, data, schema)

    def read(self, source_id: int, path: str, format: str = "parquet", **options: object) -> None:
        self.sources.read(source_id, path, format, **options)

    # --- plans

    def plan(self, plan: str | Rel) -> Rel:
        """The checked plan of a JSON document or a tree."""
        if isinstance(plan, str):
            plan = codec.read_plan(plan, self.strict)
        check(isinstance(plan, Rel), f"{type(plan).__name__} is no plan")
        return validate(plan, self.strict)

    def compile(self, plan: str | Rel) -> DataFrame:
        """A lazy DataFrame of columns c0, c1, ...; nothing runs."""
        buckets = self.options.bucket_aggregate_buckets if self.options.bucket_aggregate else None
        return Compiler(self.sources.source, self.generic, buckets).compile(self.plan(plan))

    def explain(self, plan: str | Rel, extended: bool = False) -> list[str]:
        """The plan's tree; extended also Spark's physical plan, for which the sources must be there."""
        checked = self.plan(plan)
        lines = ["Plan on Spark", *tree(checked)]
        if extended:
            df = self.compile(checked)
            lines += df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").splitlines()
        return lines

    # --- results

    def to_arrow(self, plan: str | Rel) -> pa.Table:
        return self.compile(plan).toArrow()

    def slices(self, plan: str | Rel, rows: int) -> Iterator[list]:
        """The result in slices of ``rows`` rows, one partition at a time on the driver."""
        if rows <= 0:
            raise PlanError("a slice has one row at least")
        found = self.compile(plan).toLocalIterator(prefetchPartitions=True)
        while some := list(itertools.islice(found, rows)):
            yield some
