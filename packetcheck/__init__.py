"""Document-packet reconciliation on Spark DataFrames.

Functions are ``Column -> Column`` expressions, operators take and return
DataFrames, plans put operators together into whole jobs.
"""
