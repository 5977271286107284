"""Checks of pipeline SQL: only plans that need no state across rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Node names of analysed plans on the main path that are allowed, and what else Spark puts there.
ALLOWED = frozenset("Project Filter SubqueryAlias Union Generate View LogicalRelation LogicalRDD LocalRelation StreamingRelation StreamingRelationV2 DataSourceV2Relation OneRowRelation WithCTE CTERelationRef CTERelationDef Range InMemoryRelation ExternalRDD LogicalRDD EventTimeWatermark CollectMetrics ResolvedHint".split())


class UnsupportedPlan(ValueError):
    pass


def node_names(df: DataFrame) -> list[str]:
    """Node names of the analysed plan along its main inputs, from the root."""
    out: list[str] = []

    def walk(node) -> None:
        name = node.nodeName()
        out.append(name)
        children = node.children()
        if name == "WithCTE":
            walk(node.plan())
            for k in range(node.cteDefs().size()):
                walk(node.cteDefs().apply(k))
            return
        # A view that the pipeline registered was checked when it was.
        if name in ("View", "SubqueryAlias") and name == "View":
            return
        n = 1 if name == "Union" else children.size()
        for k in range(min(n, children.size())):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().analyzed())
    return out


def check(df: DataFrame) -> DataFrame:
    """`df` if its plan only scans, projects, filters, aliases, unnests and unions; else an error that names the node."""
    for name in node_names(df):
        if name not in ALLOWED:
            raise UnsupportedPlan(f"unsupported plan: {name}")
    return df
