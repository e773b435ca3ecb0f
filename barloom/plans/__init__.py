"""Assembled plans: the registry of feature groups, full and rolling computation, market reports."""
