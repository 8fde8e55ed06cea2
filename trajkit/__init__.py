"""Spark-native analytics over agent trajectories: scans, rules, splits, summaries and training rows."""
