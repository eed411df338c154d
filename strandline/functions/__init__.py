"""Scalar functions as native expressions; Arrow where a fold can't say it."""
