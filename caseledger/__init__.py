"""Event-log and signal-resolution analytics as Spark DataFrame jobs."""
