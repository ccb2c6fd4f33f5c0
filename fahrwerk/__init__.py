"""Spark-native analytics over vehicle telemetry: context, anomaly signals and billing."""
