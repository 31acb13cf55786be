"""Subscriber analytics on PySpark: device change, usage profile and location operators."""
