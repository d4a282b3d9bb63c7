"""almanac: Spark-native analytics for versioned catalogues (snapshots, history, diffs, rollups, search)."""
