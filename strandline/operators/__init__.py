"""Relational, analytic and geometric operators over DataFrames."""
