"""DataFrame -> DataFrame operators: profiling, cleaning, statistics, models,
trend, chart data, graph and the distributed order statistics they share."""
