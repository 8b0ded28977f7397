"""Trend modelling of sampled series on Spark: cleaning, fitting, forecasting and scoring."""
