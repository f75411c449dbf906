"""inkgrain: measurement and preparation of text-recognition data on Spark SQL.

Every operator takes DataFrames and returns DataFrames.  Nothing in the package
starts a session; see :mod:`inkgrain.session` for one with sensible defaults.
"""

__version__ = "0.1.0"
