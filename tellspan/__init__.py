"""tellspan: telemetry search, series, correlation and alerting as Spark plans."""
