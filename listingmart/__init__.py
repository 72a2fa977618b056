"""listingmart: a Spark-native listing warehouse, quality gate and feature engine."""
