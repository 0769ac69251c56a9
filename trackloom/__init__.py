"""Spark-first cataloguing, matching and cleaning of media-library tables."""
