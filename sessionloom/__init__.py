"""Market-panel analytics written against the public PySpark APIs."""

__version__ = "0.1.0"
