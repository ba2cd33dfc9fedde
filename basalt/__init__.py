"""A Spark-native analytics engine: SQL and DataFrame operators planned by Catalyst."""
