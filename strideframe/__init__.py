"""Movement time series, work-cycle intervals and session logs as Spark jobs."""
