"""arbordex: project-inventory and code-intelligence analytics as Spark DataFrames."""

__version__ = "0.1.0"
