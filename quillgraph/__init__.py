"""Spark-native analytics of evidence graphs: scans, merges, roll-ups, retrieval, diffs and run logs as DataFrame plans."""
