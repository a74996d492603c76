"""sightline: Spark-native analytics over repeatedly observed listings."""

__version__ = "0.1.0"
