"""watchpost: surveillance-style detection, track and event analytics on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here runs
outside Spark: Python only appears inside Arrow-batched folds for state that is
genuinely order dependent.
"""
