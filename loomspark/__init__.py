"""Spark-native analytics toolkit: DataFrame operators, learners, graph and text programs."""
