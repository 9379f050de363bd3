"""recollect: a knowledge-graph memory engine on PySpark DataFrames."""

__version__ = "0.1.0"
