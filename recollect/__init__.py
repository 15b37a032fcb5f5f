"""Spark-native memory retrieval, decision scoring and text preparation."""
