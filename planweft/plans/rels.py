"""Plan nodes with the schemas that they give."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from planweft.errors import check
from planweft.plans.expressions import Aggregation, Expression
from planweft.types import DataType, Schema

JOINS = ("INNER", "LEFT", "FULL", "LEFT_SEMI", "LEFT_ANTI")
#: Beyond the plan language's own joins.
MORE_JOINS = ("RIGHT", "CROSS")
SIDES = ("LEFT", "RIGHT")


class Rel:
    def inputs(self) -> tuple[Rel, ...]:
        return ()

    @property
    def schema(self) -> Schema:
        raise NotImplementedError

    def walk(self):
        for x in self.inputs():
            yield from x.walk()
        yield self


@dataclass(frozen=True)
class InputSource(Rel):
    source_id: int
    columns: tuple[DataType, ...]

    @property
    def schema(self) -> Schema:
        return self.columns

    def __str__(self) -> str:
        return f"InputSource({self.source_id})[{', '.join(map(str, self.columns))}]"


@dataclass(frozen=True)
class Filter(Rel):
    input: Rel
    condition: Expression

    def inputs(self):
        return (self.input,)

    @property
    def schema(self) -> Schema:
        return self.input.schema

    def __str__(self) -> str:
        return f"Filter({self.condition})"


@dataclass(frozen=True)
class Union(Rel):
    """All rows of the inputs, or with ``distinct`` each row once (nulls equal). Schemas must agree, nullability included."""

    children: tuple[Rel, ...]
    distinct: bool = True
    strict: bool = True

    def __post_init__(self):
        check(len(self.children) >= 2, "a union needs two inputs at least")
        first = self.children[0].schema
        for x in self.children[1:]:
            same = x.schema == first if self.strict else [t.type_id for t in x.schema] == [t.type_id for t in first]
            check(same, "the inputs of a union have different schemas")

    def inputs(self):
        return self.children

    @cached_property
    def schema(self) -> Schema:
        if self.strict:
            return self.children[0].schema
        return tuple(DataType(t[0].type_id, any(x.nullable for x in t)) for t in zip(*(c.schema for c in self.children), strict=True))

    def __str__(self) -> str:
        return "Union" if self.distinct else "UnionAll"


@dataclass(frozen=True)
class HashJoin(Rel):
    type: str
    left: Rel
    right: Rel
    condition: Expression
    build_side: str | None = None

    def __post_init__(self):
        check(self.type in JOINS + MORE_JOINS, f"unknown join type {self.type!r}")
        check(self.build_side is None or self.build_side in SIDES, f"unknown build side {self.build_side!r}")
        check(self.build_side is None or self.type == "INNER", "only an inner join may name its build side")

    def inputs(self):
        return self.left, self.right

    @cached_property
    def both(self) -> Schema:
        """What the condition sees: left columns, then right ones."""
        return self.left.schema + self.right.schema

    @cached_property
    def schema(self) -> Schema:
        left, right = self.left.schema, self.right.schema
        if self.type in ("LEFT_SEMI", "LEFT_ANTI"):
            return left
        if self.type in ("FULL", "RIGHT"):
            left = tuple(t.as_nullable() for t in left)
        if self.type in ("FULL", "LEFT"):
            right = tuple(t.as_nullable() for t in right)
        return left + right

    def __str__(self) -> str:
        return f"HashJoin({self.type}, {self.condition}{f', build {self.build_side}' if self.build_side else ''})"


@dataclass(frozen=True)
class Project(Rel):
    input: Rel
    expressions: tuple[Expression, ...]

    def __post_init__(self):
        check(self.expressions, "a projection needs an expression")

    def inputs(self):
        return (self.input,)

    @cached_property
    def schema(self) -> Schema:
        return tuple(x.type for x in self.expressions)

    def __str__(self) -> str:
        return f"Project({', '.join(map(str, self.expressions))})"


@dataclass(frozen=True)
class Aggregate(Rel):
    input: Rel
    groups: tuple[Expression, ...]
    aggregations: tuple[Aggregation, ...]

    def __post_init__(self):
        check(self.aggregations and all(isinstance(x, Aggregation) for x in self.aggregations), "an aggregate needs aggregations")
        check(not any(isinstance(y, Aggregation) for x in self.groups for y in x.walk()), "a group can't be an aggregation")

    def inputs(self):
        return (self.input,)

    @cached_property
    def schema(self) -> Schema:
        return tuple(x.type for x in self.groups + self.aggregations)

    def __str__(self) -> str:
        return f"Aggregate([{', '.join(map(str, self.groups))}], [{', '.join(map(str, self.aggregations))}])"


@dataclass(frozen=True)
class SortInfo:
    expression: Expression
    descending: bool = False
    nulls_last: bool = False

    def __str__(self) -> str:
        return f"{self.expression} {'DESC' if self.descending else 'ASC'} {'NULLS_LAST' if self.nulls_last else 'NULLS_FIRST'}"


@dataclass(frozen=True)
class Sort(Rel):
    input: Rel
    infos: tuple[SortInfo, ...]

    def __post_init__(self):
        check(self.infos, "a sort needs a key")

    def inputs(self):
        return (self.input,)

    @property
    def schema(self) -> Schema:
        return self.input.schema

    def __str__(self) -> str:
        return f"Sort({', '.join(map(str, self.infos))})"


@dataclass(frozen=True)
class Limit(Rel):
    input: Rel
    n: int
    offset: int = 0

    def __post_init__(self):
        check(self.n >= 0 and self.offset >= 0, "a limit and its offset can't be negative")

    def inputs(self):
        return (self.input,)

    @property
    def schema(self) -> Schema:
        return self.input.schema

    def __str__(self) -> str:
        return f"Limit({self.offset}, {self.n})"
