"""What an executed plan's scans read."""

from __future__ import annotations


def scans(df) -> list[dict[str, int]]:
    """Files, partitions and rows of each file scan of a DataFrame, which this runs."""
    df.collect()
    out = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "ReusedExchange" in name:
            return None
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            read = {n: metrics.apply(m).value() for n, m in (("files", "numFiles"), ("partitions", "numPartitions"), ("rows", "numOutputRows")) if metrics.contains(m)}
            out.append(read | {"plan": node.simpleString(500)})
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def _nodes(node) -> list:
    name = node.nodeName()
    if "AdaptiveSparkPlan" in name:
        return _nodes(node.executedPlan())
    if "QueryStage" in name:
        return _nodes(node.plan())
    children = node.children()
    return [node] + [x for i in range(children.size()) for x in _nodes(children.apply(i))]


def records_sent(df) -> int:
    """Rows that the shuffles of an executed DataFrame wrote."""
    nodes = _nodes(df._jdf.queryExecution().executedPlan())
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in nodes if n.nodeName() == "Exchange")


def largest_method(df) -> int:
    """Bytes of the largest method in the code that is generated for a DataFrame's fused stages."""
    debug = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
