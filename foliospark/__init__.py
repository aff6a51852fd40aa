"""Document analytics on Spark: text shaping, evidence tables, concept maps and run stores as DataFrames."""

__version__ = "0.1.0"
