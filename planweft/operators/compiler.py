"""From a plan to a lazy DataFrame whose columns are c0, c1, ...

Each node is a DataFrame operation, so Catalyst sees one logical plan: filters
and columns reach the scans, aggregations combine before they shuffle, a sort
with a limit keeps only the top rows, and joins are chosen at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweft.errors import check
from planweft.functions import scalar
from planweft.functions.aggregates import ORDERED, aggregate
from planweft.plans import expressions as X
from planweft.plans import rels as R
from planweft.plans.validate import conjuncts, join_keys
from planweft.types import cast, named

HOW = {"INNER": "inner", "LEFT": "left", "FULL": "full", "LEFT_SEMI": "left_semi", "LEFT_ANTI": "left_anti", "RIGHT": "right", "CROSS": "inner"}
ARRIVAL = "__arrival"
#: Aggregations over a join's rows that follow from those of its sides' groups, and the joins that they are told for.
#: No sums: one over rows without a partner could overflow, where the joined rows have none.
BY_SIDES = ("COUNT_ALL", "COUNT_VALID", "MIN", "MAX")
MEETING = ("INNER", "LEFT", "FULL", "RIGHT")


def inner_place(x: X.Aggregation) -> bool:
    """Whether this is NTH_ELEMENT of another place than the first or the last."""
    return x.op == "NTH_ELEMENT" and x.n not in (0, -1)


def place_of(x: X.Aggregation) -> int:
    """The place from 0 on, from the end for a negative n."""
    return x.n if x.n >= 0 else -x.n - 1


def join_below(rel: R.Aggregate) -> tuple[R.HashJoin, list[int]] | None:
    """The join whose sides can be grouped before it for this aggregate, and the join's column for each input column; none if the joined rows are needed."""
    join, places = rel.input, list(range(len(rel.input.schema)))
    while isinstance(join, R.Project) and all(isinstance(x, X.ColumnRef) for x in join.expressions):
        places = [join.expressions[i].index for i in places]
        join = join.input
    plain = all(isinstance(x, X.ColumnRef) for x in (*rel.groups, *(x.operand for x in rel.aggregations))) and all(x.op in BY_SIDES for x in rel.aggregations)
    return (join, places) if plain and isinstance(join, R.HashJoin) and join.type in MEETING and join_keys(join) else None


class Compiler:
    def __init__(self, source: Callable[[R.InputSource], DataFrame], generic: scalar.Generic | None = None, buckets: int | None = None):
        """``source`` gives the DataFrame of a source; ``buckets``: partitions to deal grouped aggregations to."""
        self.source, self.generic, self.buckets = source, generic, buckets

    def column(self, x: X.Expression, names: list[str]) -> Column:
        return scalar.column(x, names, self.generic)

    def compile(self, rel: R.Rel) -> DataFrame:
        return getattr(self, type(rel).__name__.lower())(rel)

    def inputsource(self, rel: R.InputSource) -> DataFrame:
        return self.source(rel)

    def filter(self, rel: R.Filter) -> DataFrame:
        return self.compile(rel.input).where(self.column(rel.condition, named(rel.input.schema)))

    def project(self, rel: R.Project) -> DataFrame:
        names = named(rel.input.schema)
        return self.compile(rel.input).select(*(self.column(x, names).alias(f"c{i}") for i, x in enumerate(rel.expressions)))

    def union(self, rel: R.Union) -> DataFrame:
        first, *others = map(self.compile, rel.children)
        for x in others:
            first = first.union(x)  # by position
        return first.distinct() if rel.distinct else first

    def sides(self, rel: R.HashJoin) -> tuple[DataFrame, DataFrame]:
        """Both inputs with new names before the join, so that even two scans of one source can't be mistaken."""
        n, names = len(rel.left.schema), named(rel.both)
        return self.compile(rel.left).select(*(F.col(c).alias(c) for c in names[:n])), self.compile(rel.right).toDF(*names[n:])

    def condition(self, rel: R.HashJoin) -> Column:
        condition, names = None, named(rel.both)
        for x in conjuncts(rel.condition):
            # a key that may be null equals null; keys without nulls need no such test
            equal = isinstance(x, X.BinaryOp) and x.op == "EQUAL"
            if equal and (x.left.type.nullable or x.right.type.nullable):
                one = self.column(x.left, names).eqNullSafe(self.column(x.right, names))
            else:
                one = self.column(x, names)
            condition = one if condition is None else condition & one
        return condition

    def hashjoin(self, rel: R.HashJoin) -> DataFrame:
        # build_side is checked but has no effect: a hint would hash a side of any size, AQE looks at the sizes
        left, right = self.sides(rel)
        return left.join(right, self.condition(rel), HOW[rel.type])

    def over_join(self, rel: R.Aggregate, join: R.HashJoin, places: list[int]) -> DataFrame:
        """An aggregate over a join, whose sides are grouped before it: rows of one key meet as one, so many to many makes no pairs."""
        names, border = named(join.both), len(join.left.schema)
        groups = [places[x.index] for x in rel.groups]
        of = [places[x.operand.index] for x in rel.aggregations]
        kept = sorted({*groups, *(c.index for pair in join_keys(join) for c in pair)})
        met = []
        for side, df in enumerate(self.sides(join)):
            parts = [F.count(F.lit(1)).alias(f"rows{side}")]
            for i, x in enumerate(rel.aggregations):
                if x.op != "COUNT_ALL" and (of[i] >= border) == side:
                    parts.append({"COUNT_VALID": F.count, "MIN": F.min, "MAX": F.max}[x.op](names[of[i]]).alias(f"a{i}"))
            met.append(df.groupBy(*(names[k] for k in kept if (k >= border) == side)).agg(*parts))
        df = met[0].join(met[1], self.condition(join), HOW[join.type]).select("*", *(F.col(names[k]).alias(f"g{i}") for i, k in enumerate(groups)))
        keys = [f"g{i}" for i in range(len(groups))]
        if self.buckets and keys:
            df = df.repartition(self.buckets, *keys)
        rows = [F.coalesce(f"rows{side}", F.lit(1)) for side in (0, 1)]  # a row without a partner is one row
        values = []
        for i, x in enumerate(rel.aggregations):
            if x.op in ("MIN", "MAX"):
                made = (F.min if x.op == "MIN" else F.max)(f"a{i}")
            else:
                times = rows[0] * rows[1] if x.op == "COUNT_ALL" else F.coalesce(f"a{i}", F.lit(0)) * rows[of[i] < border]
                made = F.coalesce(F.sum(times), F.lit(0))
            values.append(cast(made, x.type).alias(f"a{i}"))
        grouped = df.groupBy(*keys).agg(*values)
        return grouped.select(*(cast(F.col(k), x.type) for k, x in zip(keys, rel.groups, strict=True)), *(f"a{i}" for i in range(len(values)))).toDF(*named(rel.schema))

    def aggregate(self, rel: R.Aggregate) -> DataFrame:
        if below := join_below(rel):
            return self.over_join(rel, *below)
        names, df = named(rel.input.schema), self.compile(rel.input)
        groups = [self.column(x, names).alias(f"g{i}") for i, x in enumerate(rel.groups)]
        ordered = [x for x in rel.aggregations if x.op in ORDERED]
        orders = {x.order_by for x in ordered}
        df = df.select("*", *groups)
        if () in orders:
            # arrival order as Spark reads: rows of one partition stay in order
            df = df.withColumn(ARRIVAL, F.monotonically_increasing_id())
        keys = [f"g{i}" for i in range(len(groups))]
        order = {o: F.struct(*(F.col(f"c{i}") for i in o)) if len(o) > 1 else F.col(f"c{o[0]}") if o else F.col(ARRIVAL) for o in orders}
        for x in ordered:
            check(x.op == "NTH_ELEMENT" or len(x.order_by) <= 1, f"{x.op} gives the value of one order column")
        made = {i: (x, aggregate(x, self.column(x.operand, names), order.get(x.order_by) if x.op in ORDERED else None).alias(f"a{i}")) for i, x in enumerate(rel.aggregations) if not inner_place(x)}
        if self.buckets and keys:
            df = df.repartition(self.buckets, *keys)  # the grouping reuses this exchange
        parts = []
        if made or not ordered:
            parts.append(df.groupBy(*keys).agg(*(c for _, c in made.values())))
        # an inner place takes the first rows of each group only: tasks pass on no more than that many before the shuffle
        for by in dict.fromkeys((x.order_by, x.n < 0) for x in rel.aggregations if inner_place(x)):
            wanted = {i: x for i, x in enumerate(rel.aggregations) if inner_place(x) and (x.order_by, x.n < 0) == by}
            most = max(place_of(x) for x in wanted.values()) + 1
            towards = order[by[0]].desc() if by[1] else order[by[0]].asc()
            first = df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(towards))).where(F.col("nth") <= most)
            parts.append(first.groupBy(*keys).agg(*(cast(F.max(F.when(F.col("nth") == place_of(x) + 1, self.column(x.operand, names))), x.type).alias(f"a{i}") for i, x in wanted.items())))
        grouped = parts[0]
        for p, part in enumerate(parts[1:]):  # one row a group on either side
            others = part.select(*(F.col(k).alias(f"{k}_{p}") for k in keys), *(c for c in part.columns if c not in keys))
            same = [F.col(k).eqNullSafe(F.col(f"{k}_{p}")) for k in keys] or [F.lit(True)]
            grouped = grouped.join(others, reduce(lambda a, b: a & b, same))
        values = [f"a{i}" for i in range(len(rel.aggregations))]
        return grouped.select(*(cast(F.col(k), x.type) for k, x in zip(keys, rel.groups, strict=True)), *values).toDF(*named(rel.schema))

    def sort(self, rel: R.Sort) -> DataFrame:
        names, keys = named(rel.input.schema), []
        for i in rel.infos:
            c = self.column(i.expression, names)
            if i.descending:
                keys.append(c.desc_nulls_last() if i.nulls_last else c.desc_nulls_first())
            else:
                keys.append(c.asc_nulls_last() if i.nulls_last else c.asc_nulls_first())
        return self.compile(rel.input).orderBy(*keys)

    def limit(self, rel: R.Limit) -> DataFrame:
        df = self.compile(rel.input)
        return (df.offset(rel.offset) if rel.offset else df).limit(rel.n)
