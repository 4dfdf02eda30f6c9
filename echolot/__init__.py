"""Event-detection analytics on Spark: declarative operators over frames, events and references."""
