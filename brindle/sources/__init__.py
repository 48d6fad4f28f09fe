"""Readers and writers: JSON lines, key-value lines, edge lists, node states, run folders."""
