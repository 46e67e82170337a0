"""Frame statistics, control-stream rules and corpus jobs as plain Spark DataFrame code."""
