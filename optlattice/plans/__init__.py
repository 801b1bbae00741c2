"""Strategies, sweeps, whole runs, and the catalog of queries."""
