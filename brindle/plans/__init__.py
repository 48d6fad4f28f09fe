"""Whole runs: lineage cuts, jobs, drivers."""
