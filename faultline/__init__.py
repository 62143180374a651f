"""faultline: log tables and streams in, structured error events out, on Spark."""
