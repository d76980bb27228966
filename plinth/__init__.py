"""Spark-native analytics over code models, graphs, histories and corpora."""
