"""A Spark-native engine for evaluation data: validation, scoring, grids, splits, audits and statistics."""
