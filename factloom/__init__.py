"""A PySpark engine for source facts, findings and policies over DataFrames."""
