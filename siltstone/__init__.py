"""Spark-native media-inventory analytics: DataFrame transforms for scans, rules, jobs, statistics and verification reports."""
