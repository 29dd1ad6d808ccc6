"""Spark-native analytics over listing corpora: extraction, cleaning, scoring, search and price models."""
