"""hazlens: Spark-native analytics for free-text safety reports."""
