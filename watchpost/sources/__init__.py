"""Reading and writing telemetry records."""
