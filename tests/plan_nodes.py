"""Nodes of a plan that has run, with their metrics."""


def nodes(df):
    """The physical nodes of ``df`` as run, subqueries left out.  A reused exchange is one
    node without children."""
    out = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        out.append((name, plan))
        if name != "ReusedExchangeExec":
            children = plan.children()
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def metric(plan, name):
    return plan.metrics().apply(name).value()


def scans(df, part):
    """Scans of files below a folder whose path holds ``part``."""
    return [p for n, p in nodes(df) if n == "FileSourceScanExec" and part in p.relation().location().rootPaths().toString()]


def shuffled_rows(df, column):
    """Rows written by the exchanges whose output has a column of that name."""
    found = [p for n, p in nodes(df) if n == "ShuffleExchangeExec" and column in p.output().toString()]
    return [metric(p, "shuffleRecordsWritten") for p in found]
