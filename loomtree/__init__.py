"""loomtree: Spark-native analytics over batch-segmented, annotated documents."""

__version__ = "0.1.0"
