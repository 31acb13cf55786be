"""Derived inputs, the three analyses, batch jobs, the query registry and its oracle SQL."""
