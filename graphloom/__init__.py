"""graphloom: property-graph analytics on Spark DataFrames."""
