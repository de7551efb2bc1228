"""Spark-native analytics for genomic intervals: DataFrames in, DataFrames out."""
