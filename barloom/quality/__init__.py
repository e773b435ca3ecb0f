"""Data quality: rules as data, recomputation, distributions and report grading."""
