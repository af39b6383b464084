"""codeloom: analytics over code and documentation graphs, as composable PySpark DataFrame operators."""

__version__ = "0.1.0"
