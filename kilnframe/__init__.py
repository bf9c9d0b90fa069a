"""Build-graph analytics on Spark: selection, impact, caching, events and streams as DataFrames."""
