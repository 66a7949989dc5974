"""Spark-native dimensional data pipelines: entities, sources, mappers, merge loaders, runners."""
