"""Spark-native intent scoring: intake, text predicates, scoring, identity, leads, summaries, streams."""
