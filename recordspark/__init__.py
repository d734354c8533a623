"""recordspark: declarative record transformation and analytics on PySpark."""

__version__ = "0.1.0"
