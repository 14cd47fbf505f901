"""Spark-native analytics over a bibliographic document library."""
