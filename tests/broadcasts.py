"""What the driver has broadcast, by the metrics of Spark's plans."""


def broadcast_rows(spark, work):
    """The rows of each broadcast that work() makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, runs = [], store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            if nodes.apply(k).name() != "BroadcastExchange":
                continue
            metrics = nodes.apply(k).metrics()
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    found.append(int(values.get(m.accumulatorId()).get().replace(",", "")))
    return found
