"""contingo: association / enrichment analytics as Spark DataFrame jobs.

Every operator takes DataFrames and column names and returns a DataFrame.
No operator runs a driver action; the caller decides when to act.
"""

__version__ = "0.1.0"
