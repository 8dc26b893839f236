"""aeroframe: gridded-model, observation and wind-field analytics on Spark DataFrames."""

__version__ = "0.1.0"
