"""harborlight: a Spark-native analytics library for civic-style open data."""
