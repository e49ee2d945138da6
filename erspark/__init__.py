"""erspark: entity resolution and near-duplicate analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
