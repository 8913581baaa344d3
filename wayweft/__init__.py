"""wayweft: path-network conflation and table reconciliation on PySpark."""

__version__ = "0.1.0"
