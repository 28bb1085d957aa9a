"""movekit: move, reconcile and continuously replicate relational tables on Spark.

Every operator takes DataFrames and returns a DataFrame (or a Column expression);
Catalyst and AQE choose the physical plan.
"""
