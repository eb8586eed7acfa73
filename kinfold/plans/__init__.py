"""Whole runs: operators put together, with their state."""
