"""watchplan: Spark-native analytics over surveillance-style event data."""
