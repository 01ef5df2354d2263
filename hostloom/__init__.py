"""hostloom: a PySpark-native engine for discovering infrastructure inventory in ordinary tables."""

__version__ = "0.1.0"
