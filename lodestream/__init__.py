"""Spark-native preparation, packing and scoring of training and benchmark data."""
