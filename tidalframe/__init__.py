"""Spark-native analytics over gridded surveys, adaptive meshes and ocean columns."""
