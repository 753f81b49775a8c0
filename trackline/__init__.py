"""trackline: Spark-native analytics for streams of short public messages."""
