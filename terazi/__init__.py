"""terazi: Spark-native retrieval, citation and text analytics over legal corpora."""

__version__ = "0.1.0"
