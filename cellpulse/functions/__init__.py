"""Scalar column functions built from Spark SQL built-ins."""
