"""Spark-native analytics for decentralised learning under attack, and for training data."""
