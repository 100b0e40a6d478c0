"""Spark-native analytics for stereo cloud-top heights: DataFrame in, DataFrame out."""
