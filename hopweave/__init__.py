"""Vector search, proximity-graph refinement and graph analytics as Spark DataFrames."""
