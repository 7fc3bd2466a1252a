"""parlance: a Spark-native analytics engine for entity-sentiment data extracted from news."""
