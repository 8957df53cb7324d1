"""terseforge: a Spark-native engine that scores, masks and measures text."""
