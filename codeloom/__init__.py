"""Spark-native analytics over typed code graphs and the operational data around them."""
