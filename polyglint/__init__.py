"""Data-quality rules, statistics and rewriting for source/translation text pairs on Spark."""
