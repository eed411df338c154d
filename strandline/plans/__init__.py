"""Whole queries out of operators: the graph pipeline, and the operators laid over the driver's tables."""
