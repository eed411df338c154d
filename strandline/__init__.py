"""Spark-native analytics for reconstructing family records from noisy, numbered transcriptions."""
