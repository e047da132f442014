"""Analytics over user-interface graphs, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
