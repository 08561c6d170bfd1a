"""govlake: governance analytics for a banking assistant, built on Spark SQL.

Every operator is a plain function from DataFrames to a DataFrame.  Time is a
parameter (``as_of``), never the wall clock, so the same call gives the same
rows on any cluster.
"""

__version__ = "0.1.0"
