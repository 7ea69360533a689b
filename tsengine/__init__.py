"""tsengine: regular time series across many locations, as Spark DataFrames."""

__version__ = "0.1.0"
