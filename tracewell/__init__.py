"""tracewell: evidence-bound claim graphs and event ledgers as Spark DataFrame jobs."""
