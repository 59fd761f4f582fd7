"""vellum: a PySpark-native engine for annotating, linking and scoring batches of text."""

__version__ = "0.1.0"
