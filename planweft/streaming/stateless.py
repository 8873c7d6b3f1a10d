"""Plans of nodes that need no state (sources, filters, projections, bag unions) over streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from planweft.errors import check
from planweft.plans import rels as R


def check_stateless(plan: R.Rel) -> R.Rel:
    for rel in plan.walk():
        ok = isinstance(rel, (R.InputSource, R.Filter, R.Project)) or isinstance(rel, R.Union) and not rel.distinct
        check(ok, f"{rel} needs state; over a stream only sources, filters, projections and UnionAll can run")
    return plan


def start(df: DataFrame, sink: str, checkpoint: str, query_name: str | None = None, available_now: bool = True, **options: str) -> StreamingQuery:
    """Start a compiled streaming plan; by default it ends when it has read what is there."""
    writer = df.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
