"""Spark-native evaluation of simulated series against reference observations."""
