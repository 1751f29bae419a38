"""An ordered key-value store and its scans, on Spark."""
