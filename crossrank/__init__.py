"""Evaluation of probabilistic cross-sectional forecasts on Spark.

Every public operator takes DataFrames and returns a DataFrame.  See README.md for the
layout and for the scale rules the operators follow.
"""
