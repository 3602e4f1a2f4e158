"""Rows that an executed query read from files and wrote to shuffles."""


def work(df):
    """``(rows read, rows shuffled)`` of ``df``, run to its end; an exchange that is reused counts once."""
    df.collect()
    read = shuffled = 0
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            continue
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            metrics = plan.metrics()
            if name == "FileSourceScanExec":
                read += metrics.apply("numOutputRows").value()
            elif name == "ShuffleExchangeExec":
                shuffled += metrics.apply("shuffleRecordsWritten").value()
            children = plan.children()
            plans += [children.apply(i) for i in range(children.size())]
            subqueries = plan.subqueries()
            plans += [subqueries.apply(i) for i in range(subqueries.size())]
    return read, shuffled
