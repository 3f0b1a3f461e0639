"""tidewatch: replay, limit checking and evaluation of irregular telemetry on Spark."""
